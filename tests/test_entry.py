"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parent.parent


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["c_custkey", "c_name", "orders_count"] and __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    for name in ("relquery", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') for q in e.queries() if q[2].isdigit()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_uses_the_corpus_operators():
    files = [p for p in (ROOT / "relquery").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert files and not any("relquery.llm" in p.read_text() or "corpus_pipeline" in p.read_text() for p in files)
