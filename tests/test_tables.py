import time
from pathlib import Path

from recordloom import tables


def test_held_tables_cut_lineage_and_go(spark):
    held = tables.hold(spark.range(5), "five")
    assert held.count() == 5 and held.dtypes == [("id", "bigint")]
    assert "Range" not in held._jdf.queryExecution().toString()
    folder = Path(held.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.is_dir()
    tables.drop_held(held)
    assert not folder.exists()


def test_empty_tables_can_be_held(spark):
    assert tables.hold(spark.range(0), "none").columns == ["id"]


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for folder in disk.localDirsString() for f in Path(folder).rglob("shuffle_*.data")}


def test_shuffle_files_of_held_tables_go(spark):
    before, set_before = _shuffle_files(spark), spark.conf.get(tables.CLEANUP_SETTING, None)
    counts = spark.range(10_000).selectExpr("id % 7 as k").groupBy("k").count()
    assert sorted(r["count"] for r in tables.hold(counts, "counts").collect()) == [1428] * 3 + [1429] * 4
    end = time.monotonic() + 10  # Spark deletes them in the background
    while not (gone := _shuffle_files(spark) <= before) and time.monotonic() < end:
        time.sleep(0.1)
    assert gone
    assert spark.conf.get(tables.CLEANUP_SETTING, None) == set_before
    assert counts.count() == 7
