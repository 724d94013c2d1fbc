import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from recordloom.llm import decontaminate, packing, queries

from .test_similar import kept as kept_by_brute_force


def test_names():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [f.__name__ for f in queries.queries().values()]
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    names = sorted(out.columns)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == names
    want = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in out.collect()) == want


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    current = docs
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf)
        assert current.columns == docs.columns
        ids = [r["doc_id"] for r in current.collect()]
        assert set(ids) <= kept and all(rows[r["doc_id"]] == r for r in current.collect())
        kept, after[name] = set(ids), ids
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = set(after["quality classifier"])
    assert all(labels.get(i, 1) == 1 for i in first)
    assert sum(i in first for i, y in labels.items() if y) >= 0.97 * sum(labels.values())
    second = set(after["simhash near-dedup"])
    assert second == kept_by_brute_force([(i, rows[i]["text"]) for i in first])
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = set()
    for _, text in bench:
        w = decontaminate.words(text.encode())
        wins |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    for i in second:
        w = decontaminate.words(rows[i]["text"].encode())
        hit = {p for k in range(len(w)) for n in {len(x) for x in wins} if tuple(w[k : k + n]) in wins for p in range(k, k + n)}
        assert (i in set(after["benchmark decontamination"])) == (not (hit and 20 * len(hit) >= len(w)))
    mixed = after["mixing sources"]
    packed = corpus_pipeline.run(spark, sf).collect()
    ended = [d for r in packed for d, s in zip(r["doc_ids"], r["doc_starts"]) if s == 0]
    assert sorted(ended) == sorted(mixed)
    assert all(r["n_ids"] <= packing.ROW for r in packed)


def test_stages_take_odd_and_empty_tables(spark, sf, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert 0 < out.count() <= 2 * odd.count()
        assert stage(spark, none, sf).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert sum(len([s for s in r["doc_starts"] if s == 0]) for r in last(spark, odd, sf).collect()) == odd.count()
    assert last(spark, none, sf).count() == 0
