"""Line dedup by distinct-site spread (DataFrame functions only).

Every line's hash gets a HyperLogLog sketch of the sites it stands on; sketches
merge by aggregation, map side first, so a line that a third of all rows hold
is a few sketches. Lines whose estimate is within the sketch's error of the
threshold, or within one site of it, are counted exactly. A line on
``min_sites`` sites or more is boilerplate and is taken out of every document
but the holder with the least ``doc_id``, so no passage is lost altogether.

Boilerplate lines are sent to all executors if their hashes, which are counted, fit
``SMALL_ROWS``; more of them are joined on the hash, where adaptive execution splits hot
ones. Only the positions to be dropped are gathered, by document, before they meet the texts; what
is kept is found by one set difference of positions, so a text of many lines costs a
pass.

Defined results: lines are compared without outer ASCII white space; a blank
line is never boilerplate; a null site counts as none; a null text stays null;
a document may become empty but no row is dropped; equal rows are treated
alike; a null ``doc_id`` is never the holder; an empty table gives no rows.
All columns of the input are kept; ``text``, and ``n_chars`` if there is one,
follow what is left. ``n_removed`` counts lines taken out; an input column of
that name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import checkpointed, hidden, small, table

#: log2 of the sketch's registers: a relative standard error of 1.04 / sqrt(2**12).
LG_K = 12
MIN_SITES = 8
_TRIM = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(_TRIM))


def spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """``h, holder`` of the lines (``h, site, doc_id``) that stand on ``min_sites`` sites or more."""
    error = max(1.0, 3 * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    sketched = (
        lines.groupBy("h")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("holder"), F.hll_sketch_agg("site", lg_k).alias("sketch"))
        .where(F.col("n") >= min_sites)
        .select("h", "holder", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= min_sites - error)
    )
    sure = F.col("estimate") > min_sites + error
    # one row for each line and site, made map side, so that a hot line brings few rows to the join
    sites = lines.where("site is not null").select("h", "site").distinct()
    exact = sites.join(sketched.where(~sure).select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("sites"))
    return sketched.join(exact, "h", "left").where(sure | (F.col("sites") >= min_sites)).select("h", "holder")


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source", lg_k: int = LG_K) -> DataFrame:
    key, doc, text_key, gone_at, split = hidden(documents, "key", "doc", "text", "gone", "lines")
    rows = documents.drop("n_removed").withColumn(key, F.xxhash64("text"))
    lines = rows.where("text is not null").select(F.col("doc_id").alias("doc"), F.col(site).alias("site"), F.col(key).alias("key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc", "site", "key", "pos", F.xxhash64(_key(F.col("line"))).alias("h")).where(F.col("h") != F.xxhash64(F.lit("")))
    wide = checkpointed(spread(lines.withColumnRenamed("doc", "doc_id"), min_sites, lg_k))
    gone = lines.join(small(wide), "h").where(~F.col("doc").eqNullSafe(F.col("holder")))
    gone = gone.groupBy("doc", "key").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc").alias(doc), F.col("key").alias(text_key), F.col("gone").alias(gone_at))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_key)), "left")
    joined = joined.withColumn(split, F.when(F.col(gone_at).isNotNull(), _lines(F.col("text"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone_at))
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n"))
    made = {"text": text, "n_removed": F.coalesce(F.size(gone_at), F.lit(0)).cast("long")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length(text).cast("long")
    return joined.withColumns(made).select(*[F.col(f"`{c}`") for c in documents.columns if c != "n_removed"], "n_removed")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", min_sites: int = MIN_SITES) -> str:
    """The same in SQL with exact counts of sites."""
    trimmed = r"regexp_replace(line, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, * FROM {documents}),
lines AS (
  SELECT r, doc_id, source, pos, line, {trimmed} AS trimmed
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered WHERE text IS NOT NULL)
),
wide AS (
  SELECT trimmed, min(doc_id) AS holder FROM lines WHERE trimmed <> ''
  GROUP BY trimmed HAVING count(DISTINCT source) >= {min_sites}
),
marked AS (
  SELECT l.*, w.trimmed IS NOT NULL AND l.doc_id IS DISTINCT FROM w.holder AS gone
  FROM lines l LEFT JOIN wide w ON l.trimmed = w.trimmed
),
rebuilt AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY r
)
SELECT n.doc_id, b.text, n.lang, n.source,
       CASE WHEN coalesce(b.n_removed, 0) = 0 THEN n.n_chars ELSE length(b.text) END AS n_chars,
       CAST(coalesce(b.n_removed, 0) AS BIGINT) AS n_removed
FROM numbered n LEFT JOIN rebuilt b USING (r)
"""
