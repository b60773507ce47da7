"""Token counts: an exact histogram of encoded lengths, with suffix sums.

Documents are encoded where they are read; each chunk of texts gives its counts
by length, which one aggregation adds up, so the shuffle carries lengths and
counts only. Sums over all lengths from a length upward then answer totals,
quantiles and truncated totals for every context limit without another scan.
The sums are taken in blocks of lengths and over the blocks' totals; there are
no more rows than different lengths. The histogram is checkpointed, so texts are encoded once.

Defined results: a null or empty text has length 0; equal rows count as often as
they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquery.llm.common import checkpointed, chunks, in_arrow, table, texts_of
from relquery.llm.tokens import encoder

BLOCK = 1024


def histogram(documents: DataFrame, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, rank_path).encode
        for batch in batches:
            for part in chunks(batch):
                _, first = encode(*texts_of(part.column(0)))
                length, docs = np.unique(np.diff(first), return_counts=True)
                yield pa.record_batch([pa.array(length.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["n_tokens", "n_docs"])

    counted = in_arrow(documents.select(F.col("text").cast("string").alias("text")), run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length that occurs: documents and tokens at that length or above, what is left
    of all tokens if texts are cut there, and the share of documents that are not longer."""
    counts = checkpointed(counts)  # a row for each length; it is read twice below
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    up = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    got = rows.withColumn("d", F.sum("n_docs").over(up)).withColumn("t", F.sum("tokens").over(up)).join(blocks, "block")
    docs, tokens = F.col("d") + F.col("d_above"), F.col("t") + F.col("t_above")
    return got.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("t_all") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("d_all") - docs + F.col("n_docs")) / F.col("d_all")).alias("share_not_longer"),
        F.col("t_all").alias("total_tokens"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, tokens``: what is left of all tokens at any limits, from suffix_sums."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    met = F.col("n_tokens") >= F.col("context_limit")
    first = asked.join(sums, met, "left").groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s"))
    total = sums.agg(F.max("total_tokens").alias("total"))
    left = F.coalesce(F.col("total") - F.col("s.tokens_at_least") + F.col("context_limit") * F.col("s.docs_at_least"), F.col("total"))
    return first.join(F.broadcast(total)).select("context_limit", left.alias("tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that the share of documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("share_not_longer") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(table(spark, sf_dir, "documents")))
