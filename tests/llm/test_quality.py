import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import quality as Q
from recordloom.llm.queries import fold, op9_quality


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op9_quality(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r[0] for r in rows if r[2]], [r[0] for r in rows if not r[2]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r[1] == r[2] for r in rows]) > 0.95


def test_labels_of_held_out_rows_are_not_learnt(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(fold(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (Q.train(documents, labels, fold(3) != 1) == Q.train(documents, turned, fold(3) != 1)).all()


def test_odd_rows(odd, none):
    weights = Q.fit([(b"good words", 1), (b"bad### words###", 0), (None, 1), (b"", 0)])
    out = Q.with_scores(odd, weights)
    assert out.count() == odd.count()
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert Q.with_scores(none, weights).count() == 0


def test_nothing_to_learn(spark, none, odd):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    weights = Q.train(none, labels, F.lit(True))
    assert not weights.any()
    assert {r["_score"] for r in Q.with_scores(odd, weights).collect()} == {0.5}


def test_dot_products_against_plain_sums():
    weights = np.random.default_rng(0).normal(size=(1 << 18) + 1).astype(np.float32)
    text = b"Some Words and some words ### again"
    f = Q.features(text)
    logit = float(weights[-1]) + Q.SCALE * sum(float(weights[k]) for k in f) / len(f)
    assert abs(Q.score([text], weights)[0] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_update_against_the_plain_formula():
    model, z, n, w = Q.Ftrl(4), {}, {}, {}
    rng = np.random.default_rng(1)
    for _ in range(200):
        at = np.unique(rng.integers(0, 16, 5))
        x, y = rng.random(len(at)), float(rng.integers(0, 2))
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= model.l1 else -(zi - np.sign(zi) * model.l1) / ((model.beta + ni**0.5) / model.alpha + model.l2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (p - y) * v
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / model.alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
        model.learn(at, x, y)
    assert all(np.isclose(model.z[i], z[i]) and np.isclose(model.n[i], n[i]) for i in z)


def test_copies_of_a_row_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, "good words")] * 500 + [(2, "bad### words###")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert (Q.train(docs, labels, F.lit(True), max_rows=2) == Q.train(docs.distinct(), labels, F.lit(True), max_rows=2)).all()


def test_repeats_tell_on_other_text():
    # Text made unlike that of the tables: bad rows say words twice, in a vocabulary that training has never seen.
    rng = np.random.default_rng(5)

    def rows(vocabulary, n):
        out = []
        for k in range(n):
            own = [f"{vocabulary}{i}" for i in rng.integers(0, 400, 60)]
            out.append((" ".join(own if k % 2 else [w for w in own[:30] for _ in range(2)]).encode(), k % 2))
        return out

    weights = Q.fit(rows("ab", 300))
    other = rows("xy", 100)
    found = Q.score([t for t, _ in other], weights)
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(found, other, strict=True)]) > 0.95
