"""Benchmark decontamination: SimHash of item-sized windows.

Texts and items become words: runs of ASCII letters and digits and of other
letters, A-Z and the Latin-1 capitals lowered, all else a gap. For an item of m words,
every window of m words of a document is a candidate (a shorter document is one
window). A window's SimHash of BITS bits is looked up among the items of that length by
BLOCKS blocks: fingerprints within the radius are within radius // BLOCKS in one block at
least, so none is missed, and pairs near in no block are passed over. What is found is verified
exactly: the weighted Jaccard similarity of the two bags of word shingles (a shingle's weight
is its count) must reach ``similarity``. (At a similarity of 0.8 some 15 % of bits differ, so blocks
must be searched within a radius: equal blocks alone would pass nearly every pair.)

Only windows that can reach it are fingerprinted: two bags of s shingles need
2 * similarity / (1 + similarity) * s in common, and a running count of the shingles
that any item holds bounds what a window can share. This drops no match.

Documents are scanned once for each block of ``block_items`` items or BLOCK_BYTES of text; a
block is collected and broadcast and a worker prepares it once, so what is sent and held has a
fixed bound (but for a single longer item) and a larger benchmark takes more scans, not more memory. Nothing
is shuffled. Windows are summed in stretches, so a long text needs no more than its words.

Defined results: null and empty texts and items match nothing; an item of fewer words
than a shingle is one shingle and is matched by the same words; equal rows are
reported alike; a match of several windows is reported once, with the best one
(the first of equal ones); an empty table gives no rows; in ``remove`` all
columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import checkpointed, chunks, hidden, in_arrow, mix, shingle_hashes, small, span_hashes, table, texts_of, word_spans
from relquery.llm.common import LOWER as LOWER_VALUES

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, how many may differ, and blocks. Of pairs at similarity 0.8 (angle 27 degrees) 1 in 10,000 differs in more.
BITS, RADIUS, BLOCKS = 128, 34, 5
#: Pairs of fingerprints that are compared at once.
SLAB = 1 << 20
#: Shingles of windows that are summed at once, beside one window's.
STRETCH = 4096
#: Items, and bytes of their texts, that are collected and broadcast at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_FILTER_BITS = 22

_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and each text's first word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = data.copy()
    after = np.roll(data, -1)
    latin = (data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)  # capital letters
    data[np.flatnonzero(latin) + 1] += 0x20
    word = _ASCII_WORD[data]
    signs = np.flatnonzero(data == 0xC2)  # Latin-1 signs and spaces
    word[signs], word[np.minimum(signs + 1, len(data) - 1)] = False, False
    marks = np.flatnonzero((data == 0xE2) & ((after == 0x80) | (after == 0x81)))  # dashes, quotes, spaces
    for k in range(3):
        word[np.minimum(marks + k, len(data) - 1)] = False
    starts, ends, first = word_spans(~word, offsets)
    return span_hashes(data, starts, ends, LOWER_VALUES), first


def _bits(hashes: np.ndarray) -> np.ndarray:
    """BITS signs of each hash."""
    words = np.stack([mix(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in range(BITS // 64)], axis=1)
    return (np.unpackbits(words.view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.int32) << 1) - 1


def _pack(signs: np.ndarray) -> np.ndarray:
    """Fingerprints, rows of 64-bit words, from sums of signs; a sum of 0 is a 1."""
    return np.ascontiguousarray(np.packbits(signs >= 0, axis=1)).view(np.uint64)


def simhash(hashes: np.ndarray) -> np.ndarray:
    return _pack(_bits(hashes).sum(axis=0, keepdims=True))[0]


class BlockIndex:
    """Fingerprints by blocks of bits. Two that differ in ``radius`` bits at most differ in
    radius // blocks bits at most in one block, so what is near in no block is not looked at whole;
    of random pairs 4 in 100 are."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = BLOCKS) -> None:
        self.prints, self.radius, self.near = prints, radius, radius // blocks
        self.edges = np.linspace(0, BITS, blocks + 1).astype(int)
        self.parts = self._parts(prints)

    def _parts(self, prints: np.ndarray) -> list[np.ndarray]:
        """Each block's bits as a number."""
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), BITS // 8), axis=1)
        return [bits[:, a:b].astype(np.uint32) @ (np.uint32(1) << np.arange(b - a, dtype=np.uint32)) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, print) pairs within the radius, in slabs of bounded size."""
        step = max(1, SLAB // max(1, len(self.prints)))
        parts = self._parts(queries)
        for s in range(0, len(queries), step):
            maybe = np.zeros((min(step, len(queries) - s), len(self.prints)), bool)
            for mine, own in zip(parts, self.parts, strict=True):
                maybe |= np.bitwise_count(mine[s : s + step, None] ^ own[None, :]) <= self.near
            q, p = np.nonzero(maybe)
            apart = np.bitwise_count(queries[q + s] ^ self.prints[p]).sum(axis=1)
            yield q[apart <= self.radius] + s, p[apart <= self.radius]


class Items:
    """Benchmark items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], k: int, similarity: float, radius: int) -> None:
        self.k, self.similarity = k, similarity
        self.share = 2 * similarity / (1 + similarity)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        data, offsets = texts_of(pa.array([t for _, t in items], pa.string()))
        words, first = plain_words(data, offsets)
        shingles, at = shingle_hashes(words, first, k)
        for n, (item, _) in enumerate(items):
            if m := int(first[n + 1] - first[n]):
                by_length.setdefault(m, []).append((item, shingles[at[n] : at[n + 1]]))
        self.by_length = {m: ([i for i, _ in x], [Counter(s.tolist()) for _, s in x], BlockIndex(np.stack([simhash(s) for _, s in x]), radius)) for m, x in sorted(by_length.items())}
        self.long = [m for m in self.by_length if m >= k]
        self.short = [m for m in self.by_length if m < k]
        self.known = {m: np.array(sorted({h for c in self.by_length[m][1] for h in c}), np.uint64) for m in self.short}
        self.all = np.unique(np.concatenate([np.fromiter(c, np.uint64) for m in self.long for c in self.by_length[m][1]] or [np.zeros(0, np.uint64)]))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.all >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _similarity(self, a: Counter, b: Counter) -> float:
        both = sum(min(n, b[h]) for h, n in a.items() if h in b)
        return both / (a.total() + b.total() - both)

    def _windows(self, shingles: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item length, shingles in a window, starts, fingerprints) of a document's windows that
        can match, from its shingles and which of them items hold."""
        n = len(shingles)
        upto = np.concatenate([[0], np.cumsum(held)])
        for m in self.long:
            size, wide = m - self.k + 1, min(m - self.k + 1, n)
            least = self.similarity / (1 + self.similarity) * (size + wide) - 1e-9
            if wide < self.similarity * size - 1e-9 or upto[-1] < least:
                continue
            starts = np.flatnonzero(upto[wide:] - upto[:-wide] >= least)
            cuts = np.flatnonzero(np.diff(starts) > wide) + 1  # far ones apart, and no stretch longer than STRETCH
            for near in np.split(starts, cuts) if len(starts) else ():
                for own in np.split(near, np.searchsorted(near, np.arange(near[0] + STRETCH, near[-1] + 1, STRETCH))):
                    if len(own):
                        low = int(own[0])
                        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(shingles[low : int(own[-1]) + wide]), axis=0, dtype=np.int32)])
                        yield m, wide, own, _pack(sums[own + wide - low] - sums[own - low])

    def _matched(self, shingles: np.ndarray, at: np.ndarray, held: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Fingerprints of all texts are looked up together, a length of items at a time."""
        waiting: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
        for t in texts.tolist():
            for m, *window in self._windows(shingles[at[t] : at[t + 1]], held[at[t] : at[t + 1]]):
                waiting.setdefault(m, []).append((t, *window))
        for m, found in waiting.items():
            ids, bags, index = self.by_length[m]
            text, wide = (np.repeat([f[k] for f in found], [len(f[2]) for f in found]) for k in (0, 1))
            starts, prints = (np.concatenate([f[k] for f in found]) for k in (2, 3))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for near in index.search(prints):
                for q, p in zip(*(x.tolist() for x in near), strict=True):
                    t, s, w = int(text[q]), int(starts[q]), int(wide[q])
                    got = self._similarity(Counter(shingles[at[t] + s : at[t] + s + w].tolist()), bags[p])
                    if got >= self.similarity and got > best.get((t, p), (0.0,))[0]:
                        best[t, p] = (got, s, w)
            for (t, p), (got, s, w) in best.items():
                yield t, ids[p], got, s, w + self.k - 1

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of every match."""
        words, first = plain_words(data, offsets)
        if self.long:
            shingles, at = shingle_hashes(words, first, self.k)
            held = self.filter[(shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            maybe = np.flatnonzero(held)
            held[maybe] = np.isin(shingles[maybe], self.all)
            upto = np.concatenate([[0], np.cumsum(held)])
            yield from self._matched(shingles, at, held, np.flatnonzero((upto[at[1:]] - upto[at[:-1]] > 0) & (np.diff(first) >= self.k)))
        for m in self.short:
            runs, at = shingle_hashes(words, first, self.k) if m == self.k else _whole_runs(words, first, m)
            ids, bags, _ = self.by_length[m]
            where = np.flatnonzero(np.isin(runs, self.known[m]))
            seen = set()
            for r, t in zip(where.tolist(), (np.searchsorted(at, where, "right") - 1).tolist(), strict=True):
                for item, bag in zip(ids, bags, strict=True):
                    if int(runs[r]) in bag and (t, item) not in seen:
                        seen.add((t, item))
                        yield t, item, 1.0, r - int(at[t]), m


def _whole_runs(words: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of m words, named as a text of m words is."""
    counts = np.maximum(np.diff(first) - m + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(at[-1]) - at[owner] + first[owner]
    text = np.stack([words[place + i] for i in range(m)], axis=1).ravel() if len(place) else np.zeros(0, np.uint64)
    out, _ = shingle_hashes(text, np.arange(0, len(text) + 1, m), m + 1)
    return out, at


_ready: dict[str, Items] = {}


def _prepared(sent, name: str, k: int, similarity: float, radius: int) -> Items:
    """A worker keeps the last block of items that it has prepared, by the block's name."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Items(sent.value, k, similarity, radius)
    return _ready[name]


def matches(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words, h`` of every match; h is the text's hash."""
    spark = documents.sparkSession
    ddl = "doc_id long, item_id long, similarity double, start_word long, n_words long, h long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // block_items), -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            wanted = _prepared(sent, name, k, similarity, radius)
            for batch in batches:
                for part in chunks(batch):
                    found = list(wanted.find(*texts_of(part.column(1))))
                    t = pa.array([f[0] for f in found], pa.int64())
                    columns = [pa.array([f[n] for f in found], kind) for n, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                    yield pa.record_batch([part.column(0).take(t), *columns, part.column(2).take(t)], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "h"])

        found = in_arrow(rows.select("doc_id", "text", "h"), run, ddl)
        out = found if out is None else out.union(found)
    return out


def remove(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents, all columns, without those that match an item. Matches are named by the
    text's hash and counted; up to SMALL_ROWS of them are sent to all executors, more are joined."""
    (name,) = hidden(documents, "h")
    found = checkpointed(matches(documents, benchmark, similarity, k, radius, block_items).select(F.col("h").alias(name)).distinct())
    return documents.join(small(found), F.xxhash64(documents["text"].cast("string")) == F.col(name), "left_anti")


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")
