import random
import re

from recordloom.llm import decontaminate as D

from .conftest import lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def rows(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()]


def order(found):
    return sorted(found, key=repr)


def test_random_texts_over_few_words(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab c, Dé 9".split() + ["ab"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 120))) for i in range(150)]
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(99, None), (98, " ,. "), (7, text(6))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 3, 5, 13):
        want = order(brute(docs, items, window))
        assert order(rows(D.match(df, bench, window=window))) == want
        assert order(rows(D.match(df, bench, window=window, block_words=20))) == want


def test_documents(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    found = D.match(documents, bench)
    want = order(brute([(r["doc_id"], r["text"]) for r in documents.collect()], items))
    assert order(rows(found)) == want
    assert any(n for _, _, n, _ in want)


def test_odd_rows_and_clashing_names(spark, odd):
    bench = spark.createDataFrame([("q", "some more of them to make a line"), ("q2", None)], "item_id string, text string")
    out = D.match(odd, bench)
    assert out.count() == odd.count()
    assert out.where("_n_hit > 0").count() == 4
    assert {r["items"] for r in out.collect()} == {"own"}
    assert D.clean(odd, bench).columns == odd.columns
    assert D.clean(odd, bench).count() == odd.count() - 4


def test_empty(spark, none, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.match(none, bench).count() == 0
    assert D.clean(odd, bench).count() == odd.count()


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. " * 40 + "One two THREE, four! " + "And this. " * 40), (2, "one two three four"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, bench, share=20).collect()}
    assert out == {1: "Keep this. " * 40 + "! " + "And this. " * 40, 2: None, 3: None}


def test_items_without_an_id_hit_as_one_item(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine"), (3, "ten")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three four"), (None, "seven eight"), (5, "three four five"), (None, None)], "item_id long, text string")
    for block_words in (1, 100):
        out = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in D.match(docs, bench, block_words=block_words).collect()}
        assert out == {1: (4, 2, [5, None]), 2: (2, 1, [None]), 3: (0, 0, [])}
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [3]


def test_ids_of_any_type_and_one_pass_over_texts(spark):
    import datetime
    from decimal import Decimal

    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    for kind, value in (("smallint", 3), ("date", datetime.date(2020, 1, 2)), ("decimal(5,2)", Decimal("1.50")), ("double", 0.5), ("boolean", True)):
        bench = spark.createDataFrame([(value, "two three"), (value, "three four five"), (None, "four")], f"item_id {kind}, text string")
        out = D.match(docs, bench, block_words=1)
        assert {r["doc_id"]: r["items"] for r in out.collect()} == {1: [value, None], 2: []}
        assert out._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one, in each of the four plans
