"""The cleanup passes deal their rows out, and compare a pair of names once."""

from pyspark.sql import functions as F

from recordloom.operators import fuzzy
from recordloom.plans import cleanup

from .helpers import tracks


def test_rows_of_one_file_are_cleaned_by_all(spark, monkeypatch):
    parts = {}
    real = cleanup.hold

    def hold(df, label):
        out = real(df, label)
        parts.setdefault(label, out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(cleanup, "hold", hold)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # what so few rows would go through
    spark.conf.set(setting, "false")
    try:
        one = tracks(spark, [(f"lib/{i}.zip", f"Artist {i}", f"Song {i}", None) for i in range(40)]).coalesce(1)
        assert cleanup.all_clean(one).count() == 40
    finally:
        spark.conf.unset(setting)
    assert parts["clean"] == 4


def test_a_pair_is_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def alike(a, b):
        seen.add(1)
        return 95.0

    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: alike(F.col(a), F.col(b)))
    names = spark.createDataFrame([("x", f"pete murray {c}", i) for i, c in enumerate("abcdef")], "block string, name string, n long")
    got = {r["name"]: r["target"] for r in fuzzy.merge_targets(names, ["block"], "name", 90.0).collect()}
    assert got == {f"pete murray {c}": "pete murray f" for c in "abcde"}
    assert seen.value <= 15
