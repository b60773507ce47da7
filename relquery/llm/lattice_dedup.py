"""Embedding near-dedup by lattice hashing on E8.

Every vector is scaled to length one and, in each of several tables,
projected to ``8 * sections`` random orthonormal directions, scaled and decoded to
the nearest E8 lattice point of each section. The points name a cell. A vector
stands in its own cell and probes the neighbouring cells it lies nearest to. Vectors
that meet in a cell, one of them at least as its owner, are candidates; cosine in
double precision verifies them.

Keys travel before vectors. Only a cell's name, the vector's name and a sketch of SKETCH
signs of random projections are dealt out by cell; the vectors themselves follow for those
whose sketch lies near another's in the cell (a linked pair differs in more signs than
``_signs`` allows about once in 100,000).

Copies and near copies are handled by representatives. Equal vectors are one node with a
weight. Each cell's least owner is its centre; a node whose cosine with a centre is at least
cos(a / 2), a being the angle of the threshold, joins that centre's ball. Any two members of
a ball are linked (the triangle inequality of angles), so a ball's links are counted by its
weight, and no pair of its members is ever compared.

Other pairs are compared in their cells, block by block: a block holds up to ``block``
owners, all others of the cell pass by in slabs. A pair is counted in the first
cell in which it meets only, which the task finds out by decoding the linked vectors' other
cells; so links are counted by sums and never listed.

The number of sections and tables and the scale follow the number of rows (``SCHEDULE``), so that a
cell holds some hundred vectors by chance at any size while recall stays the same.

Defined results: vectors that are null, empty or zero or hold a null or
non-finite component link with nothing and are components of their own; vectors
of different lengths never link; equal rows are different vectors that link
with each other; an empty table gives no rows; other columns are ignored. Vectors are known by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import checkpointed, components, in_arrow, mix, small, table

#: Up to so many rows: sections, scale (for 64 dimensions), probes, tables. A pair of cosine 0.9 meets
#: in a table with probability 0.64, 0.46, 0.42, 0.22, 0.11 and in one of all tables with 0.98 at least.
SCHEDULE = ((70_000, 1, 4.0, 2, 5), (300_000, 1, 5.0, 2, 8), (1_000_000, 2, 3.0, 2, 9), (30_000_000, 2, 4.0, 2, 20), (10**18, 3, 4.0, 6, 42))
SEED, BLOCK, SLAB, SKETCH = 17, 2000, 500, 128
#: Linked pairs whose cells are looked at together.
PAIRS = 20_000


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2, for rows of eight."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    halves = (1 - 2.0 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)) / 2
    return np.concatenate([np.array(out), halves[(halves < 0).sum(axis=1) % 2 == 0]])


@lru_cache(maxsize=64)
def _table_of(width: int, number: int, sections: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, width, number])
    directions = rng.standard_normal((max(width, 8 * sections), 8 * sections))
    return np.linalg.qr(directions)[0][:width], rng.random(8 * sections)


_PLACE = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _name(points: np.ndarray) -> np.ndarray:
    return mix(((2 * points).astype(np.int64).view(np.uint64) * _PLACE).sum(axis=1, dtype=np.uint64))


def cells(unit: np.ndarray, number: int, probes: int, scale: float, sections: int, seed: int) -> np.ndarray:
    """Names of each row's own cell and of the cells it probes, nearest first (1 + probes columns)."""
    directions, shift = _table_of(unit.shape[1], number, sections, seed)
    y = unit @ directions * scale + shift
    salt = np.uint64(number * 1000003 + unit.shape[1])
    parts, nears = [], []
    for s in range(sections):
        x = y[:, 8 * s : 8 * s + 8]
        point = e8(x)
        gain = (x - point) @ minimal_vectors().T
        parts.append((point, mix(_name(point) + np.uint64(s))))
        nears.append(gain)
    total = sum((h for _, h in parts), np.zeros(len(y), np.uint64))
    out = [mix(total + salt)]
    if probes:
        gain = np.concatenate(nears, axis=1)
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(gain, best, axis=1), axis=1, kind="stable"), axis=1)
        for k in range(probes):
            at, step = np.divmod(best[:, k], 240)
            h = total.copy()
            for s, (point, own) in enumerate(parts):
                here = at == s
                h[here] += mix(_name(point[here] + minimal_vectors()[step[here]]) + np.uint64(s)) - own[here]
            out.append(mix(h + salt))
    return np.stack(out, axis=1).view(np.int64)


@lru_cache(maxsize=8)
def _planes(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, SKETCH))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """SKETCH signs of each row as two 64-bit numbers."""
    return np.packbits(unit @ _planes(unit.shape[1], seed) >= 0, axis=1).view(np.int64)


def _signs(cosine: float) -> int:
    """In how many signs a pair of this cosine differs at most, but for about one in 100,000."""
    p = np.arccos(cosine) / np.pi
    return int(np.ceil(SKETCH * p + 4.3 * np.sqrt(SKETCH * p * (1 - p))))


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) by length of the vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    flat, first = np.asarray(vectors.flatten(), float), np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[first[rows][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number in each one's component, of 0 .. n - 1 joined by pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Groups:
    """Runs of rows with the same key, in order, as pieces of bounded size with a mark where a run begins."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.last = keys, None

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, pa.RecordBatch]]:
        if not batch.num_rows:
            return
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in self.keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = tuple(int(c[a]) for c in columns)
            for s in range(a, b, SLAB):
                yield own != self.last, batch.slice(s, min(SLAB, b - s))
                self.last = own


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, tables: int | None = None, probes: int | None = None, scale: float | None = None, sections: int | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row. What is not given follows SCHEDULE."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    inner = "float" if rows.schema["v"].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{inner}>"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(inner))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(inner)).otherwise(x))))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    source = rows.where("node is not null").select("node", "v")
    nodes = checkpointed(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("head"), F.count("*").alias("weight")))
    usual = next(x[1:] for x in SCHEDULE if nodes.count() <= x[0])
    sections, scale, probes, tables = (own if given is None else given for given, own in zip((sections, scale, probes, tables), usual, strict=True))

    def cells_of(unit: np.ndarray, t: int, n: int) -> np.ndarray:
        return cells(unit, t, n, scale * (unit.shape[1] / 64) ** 0.5, sections, seed)

    def spread(n: int):
        """A row for each table and cell of a vector, with n probes; a task that meets a vector again makes none."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            for batch in batches:
                names, pick = np.unique(batch.column(0).to_numpy(), return_index=True)
                pick = pick[~np.isin(names, seen)]
                seen = np.union1d(seen, names)
                part = batch.take(pa.array(np.sort(pick)))
                for at, unit in _units(part.column(1)):
                    node, sketch = part.column(0).take(pa.array(at)), sketches(unit, seed)
                    for t in range(tables):
                        for k, cell in enumerate(cells_of(unit, t, n).T):
                            made = [pa.array(np.full(len(at), t, np.int32)), pa.array(np.ascontiguousarray(cell)), pa.array(np.full(len(at), k == 0)), node, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())]
                            yield pa.record_batch(made, names=["t", "cell", "own", "node", "s1", "s2"])

        return in_arrow(source, run, "t int, cell long, own boolean, node long, s1 long, s2 long")

    def vectors(wanted: DataFrame) -> DataFrame:
        """``node, v`` of the nodes, one row each."""
        return source.join(small(wanted.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("v").alias("v"))

    # balls of near copies around the least owners of cells
    owned = spread(0).drop("own")
    centres = checkpointed(owned.groupBy("t", "cell").agg(F.count("*").alias("many"), F.min(F.struct("node", "s1", "s2")).alias("c")).where("many > 1"))
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("c.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c.s2")))
    half = float(np.cos(np.arccos(cosine) / 2)) + 1e-6
    near = owned.join(centres, ["t", "cell"]).withColumn("apart", apart).where(F.col("apart") <= _signs(half))
    chosen = checkpointed(near.groupBy("node").agg(F.min(F.struct("apart", F.col("c.node").alias("ball"))).alias("c")).select("node", F.col("c.ball").alias("ball")))
    outer = chosen.where("node <> ball")
    held = checkpointed(vectors(outer.select("node").union(outer.select("ball"))))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            other = {(int(r), u.shape[1]): u[k] for at, u in _units(batch.column(3)) for k, r in enumerate(at)}
            for at, unit in _units(batch.column(2)):
                for k, r in enumerate(at):
                    y = other.get((int(r), unit.shape[1]))
                    good[r] = y is not None and float(unit[k] @ y) >= half
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["node", "ball"])

    both = outer.join(held, "node").join(held.select(F.col("node").alias("ball"), F.col("v").alias("w")), "ball").select("node", "ball", "v", "w")
    member = checkpointed(in_arrow(both, verified, "node long, ball long"))
    centre = chosen.where("node = ball").select("node").join(member.select(F.col("ball").alias("node")).distinct(), "node", "left_semi")
    balls = checkpointed(member.union(centre.select("node", F.col("node").alias("ball"))))

    # what meets in a cell, by sketches
    near_signs = _signs(cosine)
    crowded = centres.where(F.col("many") > block).select("t", "cell", F.ceil(F.col("many") / block).cast("int").alias("blocks"))
    met = spread(probes).join(small(balls), "node", "left").join(small(crowded), ["t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.when(F.col("own"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("mine", mine).withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("mine", F.col("blocks") - 1))))
    met = met.select("t", "cell", "i", F.coalesce(F.col("mine") == F.col("i"), F.lit(False)).alias("stays"), "node", "s1", "s2", F.coalesce("ball", F.lit(0)).alias("ball"))
    key = ["t", "cell", "i"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, stay, hit, group = _Groups(key), None, None, None

        def found(rows: np.ndarray, which: np.ndarray, stays: bool) -> pa.RecordBatch:
            n = int(which.sum())
            made = [np.full(n, group[0], np.int32), np.full(n, group[1]), np.full(n, group[2], np.int32), np.full(n, stays), rows[which, 0], rows[which, 3]]
            return pa.record_batch([pa.array(x) for x in made], names=[*key, "stays", "node", "ball"])

        for batch in batches:
            for new, part in groups.pieces(batch):
                if new:
                    if hit is not None and hit.any():
                        yield found(stay, hit, True)
                    stay, hit = np.zeros((0, 4), np.int64), np.zeros(0, bool)
                    group = tuple(part.column(k)[0].as_py() for k in range(3))
                x = np.stack([part.column(k).to_numpy() for k in (4, 5, 6, 7)], axis=1)
                stays = part.column(3).to_numpy(zero_copy_only=False)
                first = len(stay)
                stay, hit = np.concatenate([stay, x[stays]]), np.concatenate([hit, np.zeros(int(stays.sum()), bool)])
                if not len(stay):
                    continue
                signs = np.bitwise_count((x[:, 1, None] ^ stay[None, :, 1]).view(np.uint64)).astype(np.int16) + np.bitwise_count((x[:, 2, None] ^ stay[None, :, 2]).view(np.uint64))
                pair = (signs <= near_signs) & (x[:, 0, None] != stay[None, :, 0]) & ((x[:, 3, None] != stay[None, :, 3]) | (x[:, 3, None] == 0))
                hit |= pair.any(axis=0)
                some = pair.any(axis=1)
                hit[first:] |= some[stays]
                if (some & ~stays).any():
                    yield found(x, some & ~stays, False)
        if hit is not None and hit.any():
            yield found(stay, hit, True)

    dealt = met.repartition(*key).sortWithinPartitions(*key, F.desc("stays"), "node")
    close_by = checkpointed(in_arrow(dealt, close, "t int, cell long, i int, stays boolean, node long, ball long").distinct())
    full = close_by.join(vectors(close_by), "node").join(nodes.select("node", "weight"), "node").select(*key, "stays", "node", "ball", "weight", "v")

    def codes(unit: np.ndarray, t: int) -> np.ndarray:
        return np.stack([cells_of(unit, s, probes) for s in range(t + 1)], axis=1)

    def first_time(a: np.ndarray, b: np.ndarray, t: int, cell: int) -> np.ndarray:
        """Whether pairs, by codes of both (table, own and probed cells), meet in this cell first."""
        before = (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)
        first = ~before[:, :t].any(axis=1)
        oa, ob = a[:, t, 0], b[:, t, 0]
        twice = (oa != ob) & (a[:, t, 1:] == ob[:, None]).any(axis=1) & (b[:, t, 1:] == oa[:, None]).any(axis=1)
        return first & (~twice | (np.minimum(oa, ob) == cell))

    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(key)
        stay: dict[int, tuple] = {}
        for batch in batches:
            for new, part in groups.pieces(batch):
                if new:
                    stay = {}
                t, cell = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                stays = part.column(3).to_numpy(zero_copy_only=False)
                node, ball, weight = (part.column(k).to_numpy() for k in (4, 5, 6))
                for at, unit in _units(part.column(7)):
                    own = (node[at], ball[at], weight[at], codes(unit, t), unit)
                    size = unit.shape[1]
                    held = stay.get(size)
                    # those who stay are in front, so what is held already meets all of this piece
                    fresh = tuple(x[stays[at]] for x in own)
                    if held is None:
                        every = fresh
                    else:
                        every = tuple(np.concatenate([p, q]) for p, q in zip(held, fresh, strict=True)) if len(fresh[0]) else held
                    stay[size] = every
                    if not len(every[0]):
                        continue
                    near = unit @ every[4].T >= cosine
                    near &= (own[1][:, None] != every[1][None, :]) | (own[1][:, None] == 0)
                    near &= own[0][:, None] != every[0][None, :]
                    # both of a pair that stay meet once: when the later one comes, with the earlier one
                    old = len(every[0]) - len(fresh[0])
                    mutual = stays[at][:, None] & (np.arange(len(every[0])) >= old)[None, :]
                    near &= ~mutual | (own[0][:, None] > every[0][None, :])
                    x, y = np.nonzero(near)
                    if not len(x):
                        continue
                    sums = {}
                    for s in range(0, len(x), PAIRS):
                        p, q = x[s : s + PAIRS], y[s : s + PAIRS]
                        first = first_time(own[3][p], every[3][q], t, cell)
                        for ids, values in ((own[0][p[first]], every[2][q[first]]), (every[0][q[first]], own[2][p[first]])):
                            some, back = np.unique(ids, return_inverse=True)
                            for i, w in zip(some.tolist(), np.bincount(back, values).astype(np.int64).tolist(), strict=True):
                                sums[i] = sums.get(i, 0) + w
                    names, back = np.unique(np.concatenate([own[0][x], every[0][y]]), return_inverse=True)
                    label = _labels(len(names), back[: len(x)], back[len(x) :])
                    moved = label != np.arange(len(names))
                    a = np.concatenate([np.array(list(sums), np.int64), names[label[moved]]])
                    b = np.concatenate([np.zeros(len(sums), np.int64), names[moved]])
                    n = np.concatenate([np.array(list(sums.values()), np.int64), np.zeros(int(moved.sum()), np.int64)])
                    yield pa.record_batch([pa.array(z) for z in (a, b, n)], schema=out_schema)

    dealt = full.repartition(*key).sortWithinPartitions(*key, F.desc("stays"), "node")
    found = checkpointed(in_arrow(dealt, compare, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    links = found.where("b = 0").groupBy("a").agg(F.sum("n").alias("links")).select(F.col("a").alias("node"), "links")
    edges = found.where("b <> 0").select("a", "b").union(balls.select(F.col("ball").alias("a"), F.col("node").alias("b")))
    roots = components(edges)
    placed = nodes.join(balls, "node", "left")
    weights = placed.where("ball is not null").groupBy("ball").agg(F.sum("weight").alias("together"))
    grouped = placed.join(weights, "ball", "left").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = grouped.groupBy("root").agg(F.min("head").alias("component"))
    count = F.coalesce("together", "weight") - 1 + F.coalesce("links", F.lit(0))
    result = grouped.join(heads, "root").select("node", count.alias("n_links"), "component")
    joined = rows.select("vec_id", "node").join(result, "node", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def oracle(embeddings: str = "embeddings", cosine: float = 0.9) -> str:
    """The same in SQL by all pairs; it agrees where no link is missed, as on the test tables."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}
),
good AS (
  SELECT r, vec_id, v FROM rows
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= {cosine} * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))
),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT reach.x, min(rows.vec_id) AS vec_id FROM reach JOIN rows ON rows.r = reach.y GROUP BY reach.x),
many AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM (
  SELECT rows.vec_id, coalesce(many.n, 0) AS n_links, least(rows.vec_id, coalesce(least.vec_id, rows.vec_id)) AS component_id
  FROM rows LEFT JOIN many ON many.x = rows.r LEFT JOIN least ON least.x = rows.r
)
"""
