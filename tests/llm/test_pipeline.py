"""The pipeline's stages, each held against brute force on its own input, and run() as their chain."""

import re
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from relquery.llm import common, quality_gam
from tests.llm.test_operators import DOCS, check_packing, groups_by_hand, matches_by_hand, near_copies, spread_by_hand

FOLDER = "/root/testdata/sf0.001"


def stage(spark, number, rows):
    """The rows that a stage keeps, as tuples."""
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.STAGES[number][1](spark, frame, FOLDER)
    if number < 4:
        assert got.columns == frame.columns and got.dtypes == frame.dtypes
        return sorted(map(tuple, got.collect()), key=str)
    return got.collect()


@pytest.fixture(scope="module")
def rows(spark):
    got = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    odd = [(1000, None, "en", "src0", None), (1001, "", "en", None, 0), (None, "no id here at all", "en", "src1", 17), (1003, "no id here at all", None, "src2", 17)]
    copies = [(2000 + i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(near_copies(30, 80, 9, 2))]
    return got + odd + copies + copies[:2]


def test_stages_are_those_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert {"pipeline"} | {f"op{n}_" for n in range(1, 11)} <= {re.sub(r"(?<=_).*", "", q) if q.startswith("op") else q for q in __spark_entry__.queries()}


def test_quality_stage(spark, rows):
    labels = common.table(spark, FOLDER, "labels")
    frame = spark.createDataFrame(rows, DOCS)
    kept = {(r.doc_id, r.predicted) for r in quality_gam.quality(frame, labels).collect()}
    assert stage(spark, 0, rows) == sorted((r for r in rows if (r[0], 1) in kept), key=str)


def test_line_stage(spark, rows):
    want = spread_by_hand([(r[0], r[1], r[3]) for r in rows], 8)
    got = stage(spark, 1, rows)
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(((d, t) for d, t, _ in want), key=str)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got if r[4] is not None)


def test_ngram_stage(spark, rows):
    numbers = groups_by_hand([r[1] for r in rows], 5, 80)
    members = defaultdict(list)
    for r, (_, n, group) in zip(rows, numbers, strict=True):
        members[group if n else None].append(r)
    want = members.pop(None) + [min(m, key=lambda r: (r[0] is None, r[0])) for m in members.values()]
    got = stage(spark, 2, rows)
    assert sorted((str(r[0]), str(r[1])) for r in got) == sorted((str(r[0]), str(r[1])) for r in want)


def test_benchmark_stage(spark, rows):
    items = [tuple(r) for r in common.table(spark, FOLDER, "benchmark").collect()]
    few = [r for r in rows if r[1] and any(t in r[1] for _, t in items)] + rows[:15] + rows[-40:]
    hit = {few[d][1] for d, _ in matches_by_hand([r[1] for r in few], items)}
    assert hit and stage(spark, 3, few) == sorted((r for r in few if r[1] not in hit), key=str)


def test_packing_stage(spark, rows):
    few = [r for r in rows[:60] if r[0] is not None]
    texts = {r[0]: r[1] for r in few}
    renamed = [(k, *r[1:]) for k, r in enumerate(few)]
    check_packing(stage(spark, 4, renamed), list(texts.values()), 1024)


def test_run_is_the_chain(spark):
    docs = common.table(spark, FOLDER, "documents")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = common.checkpointed(f(spark, docs, FOLDER))
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < docs.count() < 200


def test_empty(spark):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], DOCS), FOLDER).count() == 0
