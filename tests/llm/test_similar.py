import re

import numpy as np
import pytest

import corpus_pipeline
from recordloom.llm import similar

from .conftest import lower


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def kept(rows, tenths=8):
    """Smallest keys of the groups, each pair of sets compared."""
    least = {}
    for i, text in sorted(rows):
        least.setdefault(shingles(text), i)
    sets, ids = list(least), list(least.values())
    label = list(range(len(sets)))
    meet = {}
    for k, own in enumerate(sets):
        for s in own:
            meet.setdefault(s, []).append(k)
    for k, own in enumerate(sets):
        for j in {j for s in own for j in meet[s] if j < k}:
            if label[j] != label[k] and 10 * len(own & sets[j]) >= tenths * len(own | sets[j]):
                old, new = label[k], label[j]
                label = [new if x == old else x for x in label]
    heads = {}
    for i, x in zip(ids, label, strict=True):
        heads[x] = min(i, heads.get(x, i))
    return set(heads.values())


def written(seed=4):
    """Texts with copies of which a few words are changed, so that similarities lie about 0.8, and common passages."""
    rng = np.random.default_rng(seed)
    line = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 5000, int(rng.integers(6, 250)))] + line * int(rng.integers(0, 2))
        for _ in range(4):
            copy = list(base)
            for i in rng.integers(0, len(copy), int(rng.integers(0, max(2, len(copy) // 30)))):
                copy[i] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def found(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stage_keeps_one_of_each_group_at_eight_tenths(spark, sf):
    rows = written()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(corpus_pipeline.drop_near_copies(spark, docs, sf)) == sorted(kept(rows))


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(corpus_pipeline.drop_near_copies(spark, docs, sf)) == sorted(kept([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize(("changed", "left"), [(1, [1]), (2, [1, 2])])
def test_the_bound_itself(spark, changed, left):
    # 49 words have 45 shingles; one changed word leaves 40 of 50 (0.8), and one more takes it below.
    words = [f"w{i}" for i in range(49)]
    other = ["x" if i in (20, 40)[:changed] else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert found(similar.keep_one(df)) == left


def test_group_without_a_centre(spark):
    # Each text is similar to the next one only.
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[9 * k : 9 * k + 120])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(similar.keep_one(df)) == [0] == sorted(kept(rows))


def test_repeated_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, "other text of its own"), (None, "other text of its own"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in similar.keep_one(df).collect()) == [(0, "other"), (1, "w0 w1"), (3, "")]


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(700):
        copy = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 7))):
            copy[i] = f"n{rng.integers(10**6)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(similar.keep_one(df)) == sorted(kept(rows))
