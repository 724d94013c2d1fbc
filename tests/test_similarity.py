import random

from hypothesis import given
from hypothesis import strategies as st

from recordloom.functions.similarity import common_length, indel_ratio, ratio, similarity
from recordloom.operators import fuzzy

from .helpers import values


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_common_length(a, b):
    assert common_length(a, b) == table(a, b)


def test_known_ratios(spark):
    assert [round(x, 3) for x in values(spark, ratio("a", "b"), [("ac dc", "ac-dc"), ("pete murray", "pete muray"), ("abc", "xyz"), ("", "")], "a string, b string")] == [80.0, 95.238, 0.0, 100.0]
    assert values(spark, ratio("a", "b"), [(None, "x")], "a string, b string") == [None]
    assert values(spark, similarity("a", "b"), [("Murray, Pete", "Pete Murray"), ("Song (Mplx)", "song")], "a string, b string") == [100.0, 100.0]


def test_no_similar_pair_is_missed(spark):
    rng = random.Random(9)
    names = set()
    while len(names) < 400:
        base = "".join(rng.choice("abc de") for _ in range(rng.randint(1, 24))).strip()
        names.add(base)
        for _ in range(2):
            k = rng.randint(0, max(0, len(base) - 1))
            names.add((base[:k] + rng.choice("abx ") + base[k + rng.randint(0, 1) :]).strip())
    names.discard("")
    rows = [(n[0], n) for n in names]
    df = spark.createDataFrame(rows, "block string, name string")
    for least in (85.0, 90.0):
        want = {(x, a, b) for x, a in rows for y, b in rows if x == y and a < b and indel_ratio(a, b) >= least}
        got = {(r["block"], r["a"], r["b"]) for r in fuzzy.similar_pairs(df, ["block"], "name", least).collect()}
        assert got == want and want


def test_hot_block_makes_few_candidates(spark):
    df = spark.range(3000).selectExpr("'b' as block", "lower(substr(base64(unhex(sha2(cast(id as string), 256))), 1, 20)) as name")
    assert fuzzy.candidate_pairs(df, ["block"], "name", 90.0).count() < 3000 * 2999 / 2 / 8


def test_merge_goes_to_the_larger_then_the_smaller_name(spark):
    df = spark.createDataFrame([("x", "pete murray", 5), ("x", "pete muray", 2), ("x", "pete murrayy", 5), ("x", "other", 1)], "block string, name string, n long")
    got = {r["name"]: r["target"] for r in fuzzy.merge_targets(df, ["block"], "name", 90.0).collect()}
    assert got == {"pete muray": "pete murray", "pete murrayy": "pete murray"}


def test_no_pair_is_missed_below_two_thirds(spark):
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    df = spark.createDataFrame([("x", n) for n in names], "block string, name string")
    for least in (40.0, 50.0, 60.0, 66.0, 67.0):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if indel_ratio(a, b) >= least}
        got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, ["block"], "name", least).collect()}
        assert got == want
