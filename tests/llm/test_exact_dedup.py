import hashlib
import re
from collections import defaultdict

from recordloom.llm.exact_dedup import drop_copies, exact_dedup, marked, possible_repeats


def brute(rows):
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), i is None, i or 0, place, i))
    out = []
    for text, own in groups.items():
        keep = min(own)
        for x in own:
            out.append((x[4], keep[4], len(own), x[:3] == keep[:3], hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_odd_rows(odd):
    got = [tuple(r) for r in exact_dedup(odd).collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute(rows)
    plain = lambda rows: sorted([(r[0] or -1, r[1] or -1, r[2], r[4]) for r in rows])
    assert plain(got) == plain(want)
    assert sum(r[3] for r in got) == len({r[4] for r in got})  # one of each group, also where rows tie


def test_documents(documents):
    got = sorted(tuple(r) for r in exact_dedup(documents).collect())
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_small_filter_gives_the_same(documents):
    a = sorted(map(tuple, exact_dedup(documents).collect()))
    assert a == sorted(map(tuple, exact_dedup(documents, max_bits=32768).collect()))


def test_unrepeated_rows_go_straight_through(spark):
    df = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) as d").union(spark.createDataFrame([("x",), ("x",)], "d string"))
    marked = possible_repeats(df, "d")
    assert marked.where("d = 'x' and maybe").count() == 2
    assert marked.where("d <> 'x' and maybe").count() < 1000


def test_rows_beyond_one_filter_have_filters_of_their_own(spark):
    df = spark.range(60_000).selectExpr("sha2(cast(id as string), 256) as d").union(spark.range(50).selectExpr("sha2(cast(id as string), 256)"))
    assert possible_repeats(df, "d", 32768).where("maybe").count() > 50_000
    found = marked(df, "d", 32768)
    assert found.count() == 60_050
    assert found.where("maybe").count() < 60_050 * 0.05
    assert found.where("maybe").groupBy("d").count().where("count > 1").count() == 50


def test_no_python_in_the_plan(documents):
    plan = exact_dedup(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty(none):
    assert exact_dedup(none).count() == 0
    assert drop_copies(none).columns == none.columns


def test_drop_copies_keeps_columns(documents):
    out = drop_copies(documents)
    assert out.columns == documents.columns
    assert out.count() == exact_dedup(documents).where("kept").count()


def test_drop_copies_keeps_one_of_repeated_rows(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    assert out.count() == exact_dedup(odd).where("kept").count()
