"""Questions and records that repeat are compared once, not each with each."""

import pytest
from pyspark.sql import functions as F

from recordloom.plans import corroborate

from .helpers import tracks

RECORD = "shape string, query_artist string, query_title string, rank int, artist string, title string"


@pytest.fixture
def compared(spark, monkeypatch):
    """A counter of the pairs of texts that are compared."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def alike(a, b):
        seen.add(1)
        return 100.0 if (a or "").lower() == (b or "").lower() else 50.0

    for name in ("ratio", "similarity"):
        monkeypatch.setattr(corroborate, name, lambda a, b: alike(F.col(a), F.col(b)), raising=False)
    return seen


def test_candidate_best(spark, compared):
    asked = spark.createDataFrame([(i, "direct", "ring", "song", "Ring", None if i == 7 else "Song") for i in range(100)], "ord long, shape string, query_artist string, query_title string, our_artist string, our_title string")
    found = [("direct", "ring", "song", rank, artist, "Song") for rank in range(50) for artist in ("ring", "other")]
    best = corroborate.candidate_best(asked, spark.createDataFrame(found, RECORD), ["ord"]).collect()
    assert sorted(r["ord"] for r in best) == list(range(100))
    assert {(r["artist_sim"], r["mb_artist"], r["mb_title"]) for r in best} == {(100.0, "ring", "Song")}
    assert compared.value <= 50


@pytest.mark.parametrize(("shape", "artist"), [("title", ""), ("release", None)])
def test_corroborate(spark, compared, shape, artist):
    rows = tracks(spark, [(f"p{i}", f"Ring {i}", "Song", None) for i in range(10)])
    state = spark.createDataFrame([], "path string, status string")
    found = [(shape, artist if artist is not None else f"ring {i}", "song", rank, f"Ring {i}", "Song") for i in range(10) for rank in range(60)]
    out, settled = corroborate.corroborate(rows, state, spark.createDataFrame(found, RECORD))
    assert {r["mb_match"] for r in out.collect()} == {"title" if shape == "title" else "suggest"}
    assert compared.value <= 500
