import random
import re
from collections import defaultdict

import numpy as np

from recordloom.llm import mixing as M


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]] if total else []
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)


def check(df, tolerance=1.0, **options):
    rows = M.mix_plan(df, **options).collect()
    docs = sorted(((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect()), key=str)
    assert sorted(((r["id"], r["source"], r["size"]) for r in rows), key=str) == docs
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance * most[s] / 2 + 1
    return rows


def test_flight_keeps_totals_and_leaves_two():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(0, 60)
        sizes, chances = [rng.choice([0, 1, 5, rng.randint(0, 900)]) for _ in range(n)], [rng.choice([0.0, 1.0, 0.25, rng.random()]) for _ in range(n)]
        out = M.fly(sizes, chances, random.Random(1))
        assert sum(0 < p < 1 for p in out) <= 2
        assert abs(sum(out) - sum(chances)) < 1e-6 and abs(np.dot(out, sizes) - np.dot(chances, sizes)) < 1e-3
        assert set(M.land(sizes, chances, out)) <= {0.0, 1.0}


def test_flight_is_balanced_in_the_mean():
    chances, sizes = [0.3] * 12, [1, 2, 3, 50, 5, 6, 7, 8, 90, 10, 11, 12]
    mean = np.mean([M.fly(sizes, chances, random.Random(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_documents(documents):
    check(documents)


def test_several_levels_and_reruns(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 7, 40, 300]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = check(df.repartition(3), chunk=16)
    two = check(df.repartition(7), chunk=16)
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_odd_rows(odd):
    check(odd.select("doc_id", "text", "source"))
    out = M.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in M.mix_plan(odd).collect())


def test_empty_and_wordless(spark, none):
    assert M.mix_plan(none).count() == 0 and M.mix(none).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {(r["id"], r["target"]) for r in M.mix_plan(df).collect()} == {(1, 0.0), (2, 0.0)}


def test_rows_with_one_key_keep_their_own_copies(spark):
    rows = [(1, "w " * n, "a" if n % 2 else "b") for n in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r["size"], r["copies"]) for r in M.mix_plan(df).collect() if r["copies"])
    got = defaultdict(int)
    for r in M.mix(df).collect():
        got[len(r["text"].split())] += 1
    assert sorted(got.items()) == want


def test_reruns_agree_on_texts_whatever_the_partitions(spark):
    rows = [(None if i % 3 else i, " ".join(f"w{i}" for _ in range(1 + i % 5)), "a" if i % 4 else "b") for i in range(4000)] + [(7, "w " * 3, "a")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, M.mix(df.repartition(n), chunk=64).collect())) for n in (3, 8))
    assert one == two
    check(df, chunk=64)
    assert len(one) == sum(r["copies"] for r in M.mix_plan(df, chunk=64).collect())


def test_smallest_chunks_still_finish(spark):
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), chunk=2)
