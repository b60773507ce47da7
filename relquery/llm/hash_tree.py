"""Sharding: a hierarchical weighted hash tree (law ``key``).

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of the row's key and the child's name, and the
least draw wins, so a child is taken in proportion to its weight. A child's
draw depends on nothing else: when a weight changes, only rows that enter or
leave that subtree move, and all other rows keep their place.

The first ``founded`` shards stand in full regions. Every later one opens a region of its own
(rack 0, shard 0 in it). No old child changes its weight then, so from any count of ``founded``
or more, one more shard takes rows only into itself. Other growth is
possible with ``Tree`` itself: a shard put into an old rack moves rows into
that region, and inside it by the same rule.

Slots are gapless without one task per shard: rows are numbered in small hash
buckets, and each bucket starts where the counts of those before it end. Only
key, size and checksum are shuffled, never texts.

Defined results: a null text has size ``overhead`` and checksum 0; a null key
is a key of its own and shares one shard; equal rows share a shard and get
different slots; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquery.llm.common import table

#: Shards a region holds, racks it has and shards that found a tree, in ``balanced``.
REGION, RACKS, FOUNDED = 10, 2, 40
#: Buckets for slots, a shard. The counts, a row for each, stay below shards times this.
BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` maps the shards of rack k of region r to their weights."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def balanced(shards: int, founded: int = FOUNDED) -> Tree:
        """Regions of REGION of the founding shards in RACKS racks; then a region of one for each further shard."""
        full, regions = min(shards, founded) // REGION, []
        for r in range(full):
            ids = range(r * REGION, (r + 1) * REGION)
            regions.append(tuple(tuple((s, 1.0) for s in ids[k::RACKS]) for k in range(RACKS)))
        return Tree((*regions, *((((s, 1.0),),) for s in range(full * REGION, shards))))

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        """With one shard more, in a region of its own."""
        return Tree((*self.regions, (((shard, weight),),)))


def _weight(rack: tuple[tuple[int, float], ...]) -> float:
    return sum(w for _, w in rack)


def _children(children: list[tuple[str, float, int]]) -> Column:
    """A literal array of (name, weight, id)."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("id")) for n, w, i in children])


def _winner(key: Column, children: Column) -> Column:
    """The id of the child with the least draw; the least id of equal ones."""

    def drawn(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(children, drawn))["id"]


def place(rows: DataFrame, key: str, tree: Tree, into: str) -> DataFrame:
    """Adds the row's shard: one draw for each child of the nodes on its path."""
    regions = _children([(f"region {r}", sum(map(_weight, racks)), r) for r, racks in enumerate(tree.regions)])
    racks = F.array(*[_children([(f"rack {r} {k}", _weight(rack), k) for k, rack in enumerate(racks)]) for r, racks in enumerate(tree.regions)])
    shards = F.array(*[F.array(*[_children([(f"shard {s}", w, s) for s, w in rack]) for rack in racks]) for racks in tree.regions])
    region, rack = (f"__{into}_{x}" for x in ("region", "rack"))
    row = rows.withColumn(region, _winner(F.col(key), regions))
    row = row.withColumn(rack, _winner(F.col(key), F.get(racks, F.col(region))))
    return row.withColumn(into, _winner(F.col(key), F.get(F.get(shards, F.col(region)), F.col(rack)))).drop(region, rack)


def shard_rows(documents: DataFrame, shards: int = 40, key: str = "doc_id", overhead: int = 16, founded: int = FOUNDED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    tree = Tree.balanced(shards, founded)
    rows = documents.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = place(place(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(shards), "grown_shard")
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))  # shards * BUCKETS rows at most
    before = counts.select("shard", "__bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("__n", F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(F.broadcast(before), ["shard", "__bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("__n")).cast("long").alias("slot"), "grown_shard")


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
