import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from recordloom import oracle, queries

ROOT = Path(__file__).resolve().parents[1]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, con, name):
    out = queries.queries()[name](spark, sf)
    names = sorted(out.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in out.collect())
    sql = oracle.oracle_sql().get(name)
    assert rows or sql
    if sql:
        found = con.sql(sql)
        assert sorted(found.columns) == names
        order = [found.columns.index(c) for c in names]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "recordloom", tmp_path / "recordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_copy' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for source in (ROOT / "recordloom").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT / "recordloom").parts:
            assert "llm" not in source.read_text(), source
