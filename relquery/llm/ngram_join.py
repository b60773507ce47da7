"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set holds its distinct word shingles. Two sets are linked if
100 * |x & y| >= percent * |x | y|; both then hold T(x) = ceil(percent * |x| / 100)
elements of x at least. Equal sets are one node, so copies are never paired.

Elements are ordered by how many texts hold them, rare ones first. The counts come
from a sketch of a fixed size that every text is counted in, so an element's place is
known everywhere and costs no shuffle of elements. DivideSkip sets aside the T(x) - 1
longest of a query's lists; what is left are the lists of its first |x| - T(x) + 1 elements,
and a linked node stands in one of these.

* **Merge.** These lists are dealt by element. A list of up to ``LONG`` nodes gives its
  pairs, with the count of lists in which they meet; a pair is passed over if what follows
  the shared element in both can't reach T. Of a longer list every member meets
  the list's hub, the member with most elements in such lists (of near copies, the text
  they were made from).
* **Search.** Each node's best partner sends it to a search task: the query's whole set against
  inverted lists of the candidates' whole sets. The short lists are merged by heap; what can still
  reach T is probed in the long ones by binary search; what reaches it is verified.
  Then the pairs that lie in different components are searched likewise.
* **Crowds.** Nodes that share a long list form a crowd. Those of its members that are not
  connected to its largest component are queries against all its members, in blocks of a bounded
  number of shingles. A crowd that is connected already costs nothing, so the work on a
  group of near copies follows its size, not its pairs.

Every link is found by the search over whole sets; links between nodes known to be
connected are not looked for. Lists of elements that the sketch shows to be frequent are dealt out
in parts. Components come from distributed star contraction. Sets, nodes and elements are known
by 64-bit hashes.

Defined results: null, empty and blank texts have an empty set, are linked with
nothing and are components of their own; a text shorter than a shingle is one
shingle; equal rows are linked as equal sets; a null ``doc_id`` never names a
component unless all its ids are null; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import LOWER, SPACE, checkpointed, chunks, components, distinct_by_text, hidden, in_arrow, mix, shingle_hashes, small, span_hashes, table, texts_of, word_spans

#: Nodes in a list whose pairs are counted; members of longer ones meet the list's hub.
LONG = 64
#: Members of a list that is merged in a search; longer ones can be set aside.
SHORT = 4
#: Candidates of one query in a search task.
CANDIDATES = 512
#: Shingles in a block of a crowd.
BLOCK = 50_000
#: log2 of the sketch's counters, in how many slices they are added up, and in how many lots first.
SKETCH_BITS, SLICES, LOTS = 22, 32, 16
#: Entries of a frequent element in one part of its list.
PART = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets."""
    starts, ends, first = word_spans(SPACE[data], offsets)
    return distinct_by_text(*shingle_hashes(span_hashes(data, starts, ends, LOWER), first, k))


def node_ids(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for an empty one."""
    sizes = np.diff(offsets).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets), dtype=np.uint64)])
    return np.where(sizes > 0, mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes), np.uint64(0)).view(np.int64)


def required(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size // 100)


def overlap(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Elements that linked sets of these sizes share at least."""
    return -(-percent * (nx + ny) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The definition, on two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _batch(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], schema=schema)


def _longs(*names: str) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names])


# ---------------------------------------------------------------- sets and counts


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in one byte each if they fit."""
    return zlib.compress((counts.astype("u1") if counts.max() < 256 else counts.astype("<u8")).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw, width = zlib.decompress(data), (1 << SKETCH_BITS) // SLICES
    return np.frombuffer(raw, "u1" if len(raw) == width else "<u8").astype(np.int64)


def nodes_of(documents: DataFrame, k: int) -> DataFrame:
    """``doc_id, h, n, node, slice, counts``: for each row its text's hash, the size of its set and the set's
    name; and, with ``slice``, each task's counts of elements (a set once in each chunk of texts)."""
    ddl = "doc_id long, h long, n long, node long, slice int, counts binary"
    names = ["doc_id", "h", "n", "node", "slice", "counts"]
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray | None = None
        for batch in batches:
            for part in chunks(batch):
                sets, offsets = shingle_sets(*texts_of(part.column(2)), k)
                own, n = node_ids(sets, offsets), np.diff(offsets)
                if counts is None:
                    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
                once = np.zeros(len(own), bool)
                once[np.unique(own, return_index=True)[1]] = True
                np.add.at(counts, _bucket(sets[np.repeat(once, n)]), np.uint32(1))
                made = [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(own), pa.nulls(len(own), kinds[4]), pa.nulls(len(own), kinds[5])]
                yield pa.record_batch(made, names=names)
        if counts is not None:
            some = [(s, c) for s, c in enumerate(counts.reshape(SLICES, -1)) if c.any()]
            made = [*[pa.nulls(len(some), t) for t in kinds[:4]], pa.array([s for s, _ in some], kinds[4]), pa.array([_packed(c) for _, c in some], kinds[5])]
            yield pa.record_batch(made, names=names)

    return in_arrow(documents.select("doc_id", "h", "text"), run, ddl)


def frequencies(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all tasks' counters added up: ``_ranks`` and ``_parts``. Their size is fixed, whatever the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[s] = sums[s] + _unpacked(data) if s in sums else _unpacked(data)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_packed(c) for c in sums.values()], pa.binary())], names=["slice", "counts"])

    ddl = "slice int, counts binary"
    lots = counted.where("slice is not null").select("slice", "counts", F.pmod(F.spark_partition_id(), F.lit(LOTS)).alias("lot"))
    for key in (["slice", "lot"], ["slice"]):
        lots = in_arrow(lots.repartition(*key).select("slice", "counts"), run, ddl)
    slices = {s: bytes(data) for s, data in lots.collect()}  # SLICES rows at most
    usual = sum(int(_unpacked(data).sum()) for data in slices.values()) / (1 << SKETCH_BITS)
    ranks, parts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint16), np.ones((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint16)
    for s, data in slices.items():  # a slice at a time, as the driver has little memory to spare
        counts = _unpacked(data)
        ranks[s], parts[s] = _ranks(counts), _parts(counts, usual)
    return ranks.ravel(), parts.ravel()


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counters on a fine logarithmic scale, two bytes each."""
    return np.round(np.log2(counts + 1.0) * 512).astype(np.uint16)


def _parts(counts: np.ndarray, usual: float) -> np.ndarray:
    """Into how many parts the lists of a counter's elements are dealt: its excess over chance, by PART."""
    return np.minimum(1 + np.maximum(0, counts - usual - 6 * np.sqrt(usual)) // PART, 65_535).astype(np.uint16)


def _entries(documents: DataFrame, k: int, percent: int, sent: Broadcast) -> DataFrame:
    """``key, part, node, size, place``: an entry for each of a node's |x| - T(x) + 1 rarest elements, and the
    element's place among them; part is 0 for a list in one part. A task that meets a node again makes none.
    sent: what ``frequencies`` gives."""
    ddl, schema = _longs("key", "part", "node", "size", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, parts = sent.value
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                sets, offsets = shingle_sets(*texts_of(part.column(0)), k)
                names, pick = np.unique(node_ids(sets, offsets), return_index=True)
                new = (names != 0) & ~np.isin(names, seen)
                names, pick = names[new], pick[new]
                seen = np.concatenate([seen, names])
                n = np.diff(offsets)[pick]
                owner = np.repeat(np.arange(len(pick)), n)
                first = np.cumsum(n) - n
                keys = sets[np.arange(len(owner)) - first[owner] + offsets[pick][owner]]
                # elements ascend in a set, and the sort is stable: rank, then hash
                order = np.lexsort((ranks[_bucket(keys)], owner))
                keys, place = keys[order], np.arange(len(owner)) - first[owner]
                taken = place < (n - required(n, percent) + 1)[owner]
                keys, owner, place = keys[taken], owner[taken], place[taken]
                mine = names[owner]
                of = parts[_bucket(keys)].astype(np.uint64)
                dealt = np.where(of > 1, 1 + mix(mine.view(np.uint64)) % of, np.uint64(0))
                yield _batch(schema, keys, dealt, mine, n[owner], place)

    return in_arrow(documents.select("text"), run, ddl)


# ---------------------------------------------------------------- merge


class _Lists:
    """Inverted lists as they arrive in order of key and part; holds one short list at most."""

    def __init__(self, long: int, percent: int) -> None:
        self.long, self.percent = long, percent
        self.rest = np.zeros((0, 5), np.int64)  # key, part, node, size, place
        self.open: tuple[int, int] | None = None  # key and part of a long list that has begun

    def add(self, rows: np.ndarray, last: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, times, size of a, size of b) of pairs, a < b; for an entry of a long list
        (node, key, 0, size, -1)."""
        rows = np.concatenate([self.rest, rows])
        if not len(rows):
            return
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
        rows = rows[~again]
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(rows)))
        is_long = (length > self.long) | (rows[start, 1] > 0)
        is_long[0] |= self.open == (rows[0, 0], rows[0, 1])
        if last:
            keep = 0
        else:
            keep = 0 if is_long[-1] else length[-1]
            self.open = (int(rows[-1, 0]), int(rows[-1, 1])) if is_long[-1] else None
        self.rest = rows[len(rows) - keep :]
        done = len(rows) - keep
        of_long = np.repeat(is_long, length)[:done]
        rows, group = rows[:done], np.repeat(np.arange(len(start)), length)[:done]
        if of_long.any():
            key, _, node, size, _ = rows[of_long].T
            yield node, key, np.zeros_like(key), size, np.full_like(key, -1)
        rows, group = rows[~of_long], group[~of_long]
        _, _, node, size, place = rows.T
        pairs = []
        for step in range(1, self.long):
            a = np.flatnonzero(group[step:] == group[:-step])
            if not len(a):
                break
            b = a + step
            fits = np.minimum(size[a] - place[a], size[b] - place[b]) >= overlap(size[a], size[b], self.percent)
            a, b = a[fits], b[fits]
            pairs.append(np.stack([node[a], node[b], size[a], size[b]]))  # nodes ascend in a list
        if pairs and (p := np.concatenate(pairs, axis=1)).size:
            p = p[:, np.lexsort((p[1], p[0]))]
            new = np.flatnonzero(np.concatenate([[True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])]))
            yield p[0, new], p[1, new], np.diff(np.append(new, p.shape[1])), p[2, new], p[3, new]


def _merged(entries: DataFrame, percent: int, long: int) -> DataFrame:
    """``a, b, c, na, nb``: pairs and in how many lists they meet; entries of long lists have nb = -1, the key in b."""
    ddl, schema = _longs("a", "b", "c", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(long, percent)
        for batch in batches:
            if batch.num_rows:
                for out in lists.add(np.stack([c.to_numpy() for c in batch.columns], axis=1)):
                    yield _batch(schema, *out)
        for out in lists.add(np.zeros((0, 5), np.int64), last=True):
            yield _batch(schema, *out)

    dealt = entries.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return in_arrow(dealt, run, ddl).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- search


def divide_skip(lists: list[np.ndarray], size: int, least: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Members that stand in ``least`` of the sorted lists or more. Up to least - 1 of those longer than
    ``size`` are set aside, the longest: the others are merged by heap, and what can still reach ``least`` is probed in
    the long ones by binary search, all that is left of it at a time. ``allowed`` marks the members wanted."""
    lists = sorted(lists, key=len)
    aside = min(least - 1, sum(len(x) > size for x in lists))
    short, long = [x.tolist() for x in lists[: len(lists) - aside]], lists[len(lists) - aside :]
    counts: list[tuple[int, int]] = []
    for member, same in groupby(heapq.merge(*short) if len(short) > 1 else short[0] if short else ()):
        count = sum(1 for _ in same)
        if count >= least - aside:
            counts.append((member, count))
    members, count = (np.array(c, np.int64) for c in zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64),) * 2
    if allowed is not None:
        members, count = members[allowed[members]], count[allowed[members]]
    for k, x in enumerate(long):
        able = count + len(long) - k >= least
        if not able.all():
            members, count = members[able], count[able]
        if not len(members):
            break
        count = count + (x[np.minimum(np.searchsorted(x, members), len(x) - 1)] == members)
    return members[count >= least]


class Index:
    """Inverted lists over sets (sorted, end to end), which are numbered by size."""

    def __init__(self, sets: np.ndarray, offsets: np.ndarray) -> None:
        n = np.diff(offsets)
        self.order = np.argsort(n, kind="stable")
        self.sizes = n[self.order]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), self.sizes)
        self.sets = sets[np.arange(len(owner)) - self.at[owner] + offsets[:-1][self.order][owner]] if len(owner) else sets[:0]
        by = np.argsort(self.sets, kind="stable")
        self.element, self.member = self.sets[by], owner[by]

    def search(self, query: np.ndarray, percent: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Which of the sets are linked with the query; ``allowed`` marks those wanted."""
        size = len(query)
        if not size:
            return np.zeros(0, np.int64)
        least = int(required(np.int64(size), percent))
        low, high = np.searchsorted(self.sizes, -(-percent * size // 100)), np.searchsorted(self.sizes, 100 * size // percent, "right")
        a, b = np.searchsorted(self.element, query), np.searchsorted(self.element, query, "right")
        some = b > a
        lists = [self.member[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
        if low > 0 or high < len(self.sizes):  # sizes that can be linked stand together
            lists = [z for m in lists if len(z := m[np.searchsorted(m, low) : np.searchsorted(m, high)])]
        if len(lists) < least:
            return np.zeros(0, np.int64)
        found = divide_skip(lists, SHORT, least, None if allowed is None else allowed[self.order])
        return self.order[[m for m in found.tolist() if linked(query, self.sets[self.at[m] : self.at[m + 1]], percent)]]


def _searched(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of the pairs ``a, b``: a's set is the query, its candidates are indexed.
    A query with many candidates is searched in parts. texts: ``node, text``."""
    ddl, schema = _longs("a", "b")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    queries = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rows = queries.union(dealt.withColumn("node", F.col("b"))).join(texts, "node").select("a", "part", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, offsets = shingle_sets(*texts_of(part.column(3)), k)
                a, b = part.column(0).to_numpy(), part.column(2)
                first = np.asarray(b.is_null())
                b = b.fill_null(0).to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(first), [len(a)]])
                out: list[tuple[int, int]] = []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if s < e and first[s]:
                        query = sets[offsets[s] : offsets[s + 1]]
                        s += 1
                    if s < e:
                        own = offsets[s : e + 1]
                        found = Index(sets[own[0] : own[-1]], own - own[0]).search(query, percent)
                        out += [(int(a[s]), int(b[s + m])) for m in found.tolist()]
                flat = np.array(out, np.int64).reshape(-1, 2)
                yield _batch(schema, flat[:, 0], flat[:, 1])

    # a null comes before all others, so the query is read first
    return in_arrow(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")), run, ddl)


def _crowd_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links of the strays (members, ``crowd, node, n, root, stray, text``, that are not in their crowd's
    largest component) with any member of their crowd that has another root."""
    ddl, schema = _longs("a", "b")
    sizes = members.groupBy("crowd").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("stray"), F.col("n"))) / BLOCK).cast("int").alias("lots"))
    rows = members.join(small(checkpointed(sizes.where("lots > 0"))), "crowd")
    block, lot = (F.pmod(F.xxhash64("node", F.lit(c)), F.col(c)).cast("int") for c in ("blocks", "lots"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    index = rows.select("crowd", block.alias("block"), F.explode(upto("lots")).alias("lot"), F.lit(False).alias("asks"), "node", "root", "text")
    asked = rows.where("stray").select("crowd", F.explode(upto("blocks")).alias("block"), lot.alias("lot"), F.lit(True).alias("asks"), "node", "root", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets, offsets = shingle_sets(*texts_of(group.column("text")), k)
        asks, node, root = (group.column(c).to_numpy() for c in ("asks", "node", "root"))
        held = np.flatnonzero(~asks)
        flat = np.concatenate([sets[offsets[i] : offsets[i + 1]] for i in held]) if len(held) else sets[:0]
        index = Index(flat, np.concatenate([[0], np.cumsum(np.diff(offsets)[held])]).astype(np.int64))
        out: list[tuple[int, int]] = []
        for q in np.flatnonzero(asks):
            found = index.search(sets[offsets[q] : offsets[q + 1]], percent, root[held] != root[q])
            out += [(int(node[q]), int(node[held[m]])) for m in found.tolist()]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    key = ["crowd", "block", "lot"]  # a task's work follows pairs, not bytes, so few bytes are not put together
    dealt = asked.union(index).repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.groupBy(*key).applyInArrow(run, ddl)


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """With the root of the node; a node in no edge is its own."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(known, node, "left").withColumn(root, F.coalesce(root, node))


def near_groups(documents: DataFrame, k: int = 4, percent: int = 85, long: int = LONG) -> DataFrame:
    """``doc_id, n_shingles, component_id, root, h`` for every row: root names the component, h is the text's hash."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    read = checkpointed(nodes_of(rows, k))
    named = read.where("slice is null").select("doc_id", "h", "n", "node")
    sent = documents.sparkSession.sparkContext.broadcast(frequencies(read))
    merged = checkpointed(_merged(_entries(rows, k, percent, sent), percent, long))
    sent.destroy()  # the checkpoint needs it no longer
    pairs = merged.where("nb >= 0")
    longs = merged.where("nb < 0").select(F.col("a").alias("node"), F.col("b").alias("key"), F.col("na").alias("n"))
    per_node = longs.groupBy("node").agg(F.count("*").alias("held"))
    hubs = longs.join(per_node, "node").groupBy("key").agg(F.max(F.struct("held", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    spokes = checkpointed(longs.join(hubs, "key").where("hub <> node").groupBy("hub", "node").agg(F.count("*").alias("c")))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(longs.select("node")).distinct()
    # a row for each node before it meets anything, so that copies, however many, are one row
    nodes = named.where("n > 0").withColumn("r", F.xxhash64("doc_id", "h")).groupBy("node", "n").agg(F.min("r").alias("r"), F.min("doc_id").alias("head"))
    nodes = checkpointed(nodes)
    holders = checkpointed(nodes.join(wanted, "node", "left_semi").select("r", "node", "n"))
    texts = checkpointed(rows.select(F.xxhash64("doc_id", "h").alias("r"), "text").join(small(holders), "r").dropDuplicates(["node"]).select("node", "n", "text"))
    plain = texts.select("node", "text")

    ends = pairs.select("a", "b", "c").union(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b"), "c"))
    first = ends.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    links = checkpointed(_searched(first, plain, k, percent))
    roots = checkpointed(components(links))
    rest = _rooted(_rooted(pairs.select("a", "b"), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    later = checkpointed(_searched(rest, plain, k, percent))

    loose = _rooted(_rooted(spokes, roots, "hub", "rh"), roots, "node", "rn").where("rh <> rn")
    if not loose.isEmpty():
        placed = components(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("crowd"))
        placed = checkpointed(_rooted(placed, roots, "node", "root"))
        main = placed.groupBy("crowd", "root").agg(F.count("*").alias("many")).groupBy("crowd").agg(F.max(F.struct("many", "root")).alias("main"))
        members = placed.join(main.select("crowd", F.col("main.root").alias("main")), "crowd").withColumn("stray", F.col("root") != F.col("main"))
        later = later.union(checkpointed(_crowd_links(members.join(texts, "node"), k, percent)))
    if not later.isEmpty():
        roots = components(links.union(later))
    rooted = _rooted(nodes.select("node", "head"), roots, "node", "root")
    heads = rooted.groupBy("root").agg(F.min("head").alias("least"))
    placed = rooted.select("node", "root").join(heads, "root")
    joined = named.join(placed, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "node").alias("root"), "h")


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80, long: int = LONG) -> DataFrame:
    """The documents, all columns, with one row of each component: the one with the least doc_id
    (null ids last), then the least hash of the text. Texts without words stay, all of them."""
    mine, chosen_id, chosen_h = hidden(documents, "h", "id", "ch")
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    groups = near_groups(documents, k, percent, long).where("n_shingles > 0")
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias(chosen_id), F.col("c.h").alias(chosen_h))
    rows = documents.where(~blank).withColumn(mine, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(chosen, (F.col(mine) == F.col(chosen_h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(chosen_id)), "left_semi")
    return rows.dropDuplicates(["doc_id", mine]).drop(mine).union(documents.where(blank))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def oracle(documents: str = "documents", k: int = 4, percent: int = 85) -> str:
    """All links by an equi-join on shingles, then least ids along them."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {documents}
),
shingles AS (
  SELECT DISTINCT doc_id, {run} AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - {k - 2})) AS i FROM worded WHERE len(w) >= {k})
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND {k - 1}
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))
),
reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS component_id
FROM {documents} d LEFT JOIN sizes s USING (doc_id)
"""
