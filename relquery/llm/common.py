"""Shared parts of the corpus operators: tables, checkpoints, byte kernels, components.

The byte kernels work on many texts laid end to end in one byte array, so the
cost per text is a few vectorised passes and no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to or from Python, unless the session sets its own bound.
BATCH_BYTES = 4 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    The folder is the cluster's shared one, which the session names. A folder of our
    own is set only where none is named and driver and executors are one process, as in
    local tests; a cluster without a shared folder is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="relquery-"))
    return df.checkpoint(eager=True)


def hidden(frame: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of the frame has, in any case of letters."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _free() -> None:
    """Give memory back that the task's arrays held, as Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


#: Rows of a few numbers that may be broadcast.
SMALL_ROWS = 200_000


def small(frame: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows, else joined as Spark decides. It is counted, as estimates of joins are rough,
    so give a checkpointed or cheap one, of numbers only."""
    return F.broadcast(frame) if frame.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else frame


def in_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes and workers that return their memory."""
    conf = frame.sparkSession.conf
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound) in ("67108864", "67108864b", "64m", "64MB"):  # Spark's default
        conf.set(bound, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _free()

    return frame.mapInArrow(lean, schema)


def native_words(text: Column) -> Column:
    """Words of a text, split at space, tab, line feed, vertical tab, form feed, return."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


# --------------------------------------------------------------------------- bytes


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than texts) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, and one row at least."""
    _, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


def _values(fold: np.ndarray) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[fold]


def _fold_az() -> np.ndarray:
    fold = np.arange(256)
    fold[65:91] += 32
    return fold


#: Byte values with A-Z as a-z.
LOWER = _values(_fold_az())
#: Byte values as they are.
EXACT = _values(np.arange(256))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's first word (one more entry than texts)."""
    n = len(space)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:n]))
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _power_table(_MULTIPLIER, n, "powers"), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(_INVERSE, n + 1, "inverses")[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray, values: np.ndarray) -> np.uint64:
    """The hash of one long span, a stretch at a time."""
    total, factor, step = 0, 1, pow(_MULTIPLIER, CHUNK_BYTES, 1 << 64)
    for a in range(0, len(data), CHUNK_BYTES):
        part = values[data[a : a + CHUNK_BYTES]]
        total += factor * int((part * _power_table(_MULTIPLIER, len(part), "powers")).sum())
        factor = factor * step % (1 << 64)
    return np.uint64(mix_one(total + len(data)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial modulo 2**64. Spans ascend and do not
    overlap; long data is taken in stretches, so it needs little more than itself."""
    if len(data) <= 2 * CHUNK_BYTES:
        return _span_hashes(data, starts, ends, values)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        if ends[i] - low > 2 * CHUNK_BYTES:
            out[i] = _long_hash(data[low : ends[i]], values)
            i += 1
            continue
        j = int(np.searchsorted(ends, low + 2 * CHUNK_BYTES, "right"))
        out[i:j] = _span_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low, values)
        i = j
    return out


_PLACE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within each text and each text's first run.

    A text with fewer words, but some, has one run: the whole text.
    """
    counts = np.diff(first)
    sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        sums += words[i : len(words) - k + 1 + i] * _PLACE[i] if len(sums) else 0
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), made)
    at = np.arange(offsets[-1]) - offsets[owner] + first[owner]
    out = np.zeros(offsets[-1], np.uint64)
    long = counts[owner] >= k
    out[long] = mix(sums[at[long]])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        run = words[first[i] : first[i + 1]]
        out[offsets[i]] = mix_one(int((run * _PLACE[: len(run)]).sum()) + len(run) * 0x5851F42D4C957F2D)
    return out, offsets


def distinct_by_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and their offsets."""
    out = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offsets].astype(np.int64)


# --------------------------------------------------------------------------- graph


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an undirected graph; root is its component's least node.

    Alternating large-star and small-star steps, each an aggregation and a join
    on the node, until no edge changes. Every step is checkpointed. The hub of
    a large star meets its neighbours through an aggregated minimum, so no list
    of neighbours is ever gathered. Self loops keep a lone node; null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, sign = nodes.where("u <> v"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpointed(small)
        was, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == was or sign[0] == 0:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    every = nodes.select("u").union(nodes.select(F.col("v"))).distinct()
    return every.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("root"))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
