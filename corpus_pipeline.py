"""A corpus pipeline of five stages; each works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the
last return the columns of ``documents``. SQL can't express the stages (learned
scores, fingerprints, tokens), so ``ORACLE_SQL`` is None and tests use brute force.

Defined results of every stage: a null text counts as an empty one; empty and blank texts
are scored like any other, hold no boilerplate and no benchmark item, have no near
duplicates and are packed as their closing id; a null ``doc_id`` is a row like others; equal rows
are treated alike, and one of them stays where copies go; texts of any length are taken
whole; an empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relquery.llm import decontaminate, line_spread, ngram_join, quality_gam, ss_packing
from relquery.llm.common import checkpointed, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gam.reject(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for one holder each."""
    return line_spread.remove_boilerplate(docs).drop("n_removed")


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into token windows."""
    return ss_packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is checkpointed before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = checkpointed(docs) if k < len(STAGES) - 1 else docs
    return docs
