"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import math
import os

import duckdb
import pytest

import relquery.queries as catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return v if v is None or isinstance(v, (bool, int, str)) else str(v) if not hasattr(v, "as_tuple") else float(f"{float(v):.6g}")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.partition('.')[0]} as select * from '{FOLDER}/{f}'")
    got = con.execute(catalogue.oracle_sql()[name])
    named = [d[0] for d in got.description]
    order = sorted(range(len(named)), key=lambda k: named[k])
    assert columns == sorted(named)
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)
