from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import language as L
from recordloom.llm.queries import fold


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fold(4) != 2, docs_each=60)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    model = L.Crf(["a", "b", "c"], {})
    model.trans, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    emission, lengths = rng.normal(size=(3, 5, 3)), np.array([5, 3, 1])
    gamma, expected, logz = model.marginals(emission, lengths, pairs=True)
    want_pairs, want_z = np.zeros((3, 3)), 0.0
    for s, n in enumerate(lengths):
        weights = {}
        for path in product(range(3), repeat=int(n)):
            score = model.start[path[0]] + sum(emission[s, t, y] for t, y in enumerate(path)) + sum(model.trans[x, y] for x, y in zip(path, path[1:]))
            weights[path] = np.exp(score)
        z = sum(weights.values())
        want_z += np.log(z)
        for t in range(n):
            own = [sum(w for p, w in weights.items() if p[t] == y) / z for y in range(3)]
            assert np.allclose(gamma[s, t], own)
        for path, w in weights.items():
            for x, y in zip(path, path[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(expected, want_pairs)
    assert np.isclose(logz, want_z)


def test_parts_of_a_text_have_the_marginals_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = L.Crf(["a", "b", "c"], {})
    model.w, model.trans, model.start = rng.normal(size=model.w.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    texts = [[f"w{i}" for i in rng.integers(0, 50, n)] for n in (1, 7, 8, 9, 0, 200, 16)]
    monkeypatch.setattr(L, "LENGTH", 1000)
    whole = L.Tagger(model).tag(texts)
    monkeypatch.setattr(L, "LENGTH", 8)
    for a, b in zip(whole, L.Tagger(model).tag(texts), strict=True):
        assert a.shape == b.shape and np.allclose(a, b)


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    model = L.Crf(["a", "b"], {})
    model.trans, model.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    emission, lengths = rng.normal(size=(2, 4, 2)), np.array([4, 2])
    _, expected, base = model.marginals(emission, lengths, pairs=True)
    for i, j in product(range(2), repeat=2):
        model.trans[i, j] += 1e-6
        assert np.isclose((model.marginals(emission, lengths, pairs=True)[2] - base) / 1e-6, expected[i, j], atol=1e-4)
        model.trans[i, j] -= 1e-6


def test_copies_of_a_row_do_not_fill_the_sample(spark):
    rows = [(None, "alpha beta gamma", "a")] * 3000 + [(1, "dos tres cuatro", "b")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert [lang for lang, _ in L.Tagger(model).languages(["alpha beta", "tres"])] == ["a", "b"]


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(fold(4) == 2)
    rows = L.with_languages(docs, model).where("lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_switches_within_a_text(spark, model, documents):
    rows = {r["lang"]: r["text"] for r in documents.where("length(text) between 500 and 3000 and lang is not null").collect()}
    text = " ".join(" ".join(rows[lang].split()[:30]) for lang in ("en", "de", "fr"))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: [w["lang"] for w in r["words"]] for r in L.with_word_languages(df, model).collect()}
    own = found[1]
    third = len(own) // 3
    for k, lang in enumerate(("en", "de", "fr")):
        part = own[k * third : (k + 1) * third]
        assert part.count(lang) > 0.7 * len(part)
    assert found[2] == []


def test_odd_rows(odd, none, model):
    out = {(r["doc_id"], r["text"]): (r["_lang_pred"], r["_score"]) for r in L.with_languages(odd, model).collect()}
    for (_, text), (lang, score) in out.items():
        letters = any(c.isalpha() for c in text or "")
        assert (lang == "und") == (not letters)
        assert 0 <= score <= 1
    assert L.with_languages(none, model).count() == 0


def test_numerals_are_no_letters(spark, model):
    df = spark.createDataFrame([(1, "² ½ 12 _"), (2, "²a")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in L.with_languages(df, model).collect()} == {1: True, 2: False}


def test_nothing_to_learn(none, odd):
    model = L.train(none, F.lit(True))
    assert model is None
    assert {r["_lang_pred"] for r in L.with_languages(odd, model).collect()} == {"und"}


def test_language_of_held_out_rows_is_not_learnt(documents):
    turned = documents.withColumn("lang", F.when(fold(4) == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (L.train(d, fold(4) != 2, docs_each=5) for d in (documents, turned))
    assert a.languages == b.languages and (a.w == b.w).all()


def test_long_words_are_read_whole():
    assert L.pieces("a" * 40) == ["a" * 40]
    for word in ("a" * 41, "x" * 1000, "漢" * 14, "漢字é🙂a" * 99, "é" * 21):
        found = L.pieces(word)
        assert "".join(found) == word and len(found) > 1
        sizes = [len(p.encode()) for p in found]
        assert max(sizes) <= L.PIECE and min(sizes) >= L.PIECE // 4
    assert "".join(L.tokens("漢字" * 500)) == "漢字" * 500


def test_middle_of_a_text_without_spaces_counts():
    rows = [("alpha beta gamma delta " * 50, "a"), ("юла жук щит чаща " * 50, "b")]
    model = L.fit(rows)
    glued = "alphabetagammadelta" + "юлажукщитчаща" * 100 + "alphabetagammadelta"
    mixed = "юлажукщитчаща" * 100 + " alpha beta gamma"
    assert [lang for lang, _ in L.Tagger(model).languages([glued, mixed])] == ["b", "b"]


def test_each_language_has_its_share_of_the_words(spark):
    assert L.shares([5, 100, 100], 65) == [5, 30, 30]
    assert L.shares([5, 100], 1000) == [5, 100]
    rows = [(i, "alpha beta gamma delta " * 50, "a") for i in range(20)] + [(100 + i, "uno dos tres cuatro " * 5, "b") for i in range(2)]
    by = {"a": "alpha beta gamma", "b": "dos tres cuatro"}
    texts = [(text, lang) for _, text, lang in rows]
    model = L.fit(texts, max_words=400)
    assert L.Tagger(model).languages(list(by.values()))[1][0] == "b"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, F.lit(True), max_words=400)
    assert [lang for lang, _ in L.Tagger(model).languages(list(by.values()))] == ["a", "b"]
