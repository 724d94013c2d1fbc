import re

import numpy as np
import pytest
import xxhash

from recordloom.llm import simhash as Z

from .conftest import lower


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def joined(prints, bits):
    forest = Z.Forest(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits):
            forest.join(i, int(i + 1 + j))
    return [forest.find(i) for i in range(len(prints))]


def prints_with_a_ball(seed=3):
    rng = np.random.default_rng(seed)

    def noisy(x, k):
        for i in rng.choice(64, k, replace=False):
            x ^= 1 << int(i)
        return x

    base = [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    found = set(base) | {0}
    for b in base[:80]:
        found |= {noisy(b, int(rng.integers(1, 6))) for _ in range(6)}
    found |= {noisy(base[0], int(rng.integers(1, 5))) for _ in range(700)}
    return np.array(sorted(found), dtype=np.uint64)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_links_within_a_shard(bits):
    prints = prints_with_a_ball()
    forest = Z.Forest(len(prints))
    for a, b in Z.shard_links(prints, bits):
        forest.join(a, b)
    assert [forest.find(i) for i in range(len(prints))] == joined(prints, bits)


@pytest.mark.parametrize("bits", [2, 3])
@pytest.mark.parametrize("small", [{}, {"sample": 300, "shard": 64, "shard_max": 150}])
def test_links_over_shards(spark, bits, small):
    prints = prints_with_a_ball(5)
    rows = [(0, int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints.tolist())]
    nodes = spark.createDataFrame(rows, "table int, fp long, node long")
    found = {r["node"]: r["component"] for r in Z.components(Z.link_fingerprints(nodes, bits, **small)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == joined(prints, bits)


def test_long_chain(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in Z.components(links).collect()} == {0}


def check(df):
    """Against brute force, by row: a row without a key links like others."""
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {}
    for r in Z.near_duplicates(df).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    prints = [fingerprint(t) for _, t in rows]
    label = joined(np.array(prints, dtype=np.uint64), 2)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = {}
    for (i, _), p, c in zip(rows, prints, label):
        want.setdefault(i, []).append((f"{p:016x}", least.get(c)))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_odd_rows(odd):
    check(odd)


def prints_by_row(spark, monkeypatch, rows):
    """Components of rows (id, fingerprint) in order, the fingerprints as they are given."""
    df = spark.createDataFrame([(i, k) for k, (i, _) in enumerate(rows)], "doc_id long, k long")
    fps = {k: p for k, (_, p) in enumerate(rows)}
    table = df.rdd.map(lambda r: (r["doc_id"], r["k"], [fps[r["k"]]])).toDF("id long, mark long, fps array<long>")
    monkeypatch.setattr(Z, "with_fingerprints", lambda *_: table)
    return sorted((r["fingerprint"], r["component_id"]) for r in Z.near_duplicates(df, "doc_id").collect())


def test_rows_without_a_key_link(spark, monkeypatch):
    assert prints_by_row(spark, monkeypatch, [(1, 0), (None, 3), (9, 15)]) == [(f"{p:016x}", 1) for p in (0, 3, 15)]


def test_rows_that_share_a_key_are_told_apart(spark, monkeypatch):
    far, one = 0xFFFF, 1
    found = prints_by_row(spark, monkeypatch, [(5, 0), (5, far), (2, one), (3, far ^ 1)])
    assert found == [(f"{0:016x}", 2), (f"{1:016x}", 2), (f"{far ^ 1:016x}", 3), (f"{far:016x}", 3)]


def test_very_long_chain(spark):
    links = spark.range(100_000).selectExpr("id as a", "id + 1 as b")
    assert Z.components(links).where("component <> 0").count() == 0


def test_documents(documents):
    check(documents)


def test_empty(none):
    assert Z.near_duplicates(none).count() == 0
    assert Z.near_duplicates(none, tables=3).count() == 0
    assert Z.keep_one(none).columns == none.columns


def test_several_tables_find_more_and_hold_equal_texts(documents):
    one = {r["doc_id"]: r["component_id"] for r in Z.near_duplicates(documents, size=5, bits=3).collect()}
    many = {r["doc_id"]: r["component_id"] for r in Z.near_duplicates(documents, size=5, bits=3, tables=4).collect()}
    assert all(many[a] == many[b] for a, b in one.items())
    kept = {r["doc_id"] for r in Z.keep_one(documents, size=5, bits=3, tables=4).collect()}
    assert kept == set(many.values())


def test_near_copy_of_a_long_text_goes(spark):
    words = [f"w{i * 7919 % 10007}" for i in range(800)]
    other = list(words)
    other[400] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in Z.keep_one(df, size=5, bits=3, tables=8).collect()) == [1, 3]


def test_repeated_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, "other text of its own"), (None, "other text of its own"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), (r["text"] or "")[:5]) for r in Z.keep_one(df, size=5, bits=3, tables=2).collect())
    assert got == [(0, "other"), (1, "w0 w1"), (3, "")]
