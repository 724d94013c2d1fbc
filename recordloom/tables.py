"""Tables written in the cluster's shared folder to cut lineage, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: Whether Spark deletes the shuffle files of a query as it ends, instead of when the driver next collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that open ``tidy`` blocks have to delete.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset a local folder of our own, for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, in the shared folder."""
    return f"{shared_folder(spark)}/recordloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has put in the shared folder; results that read it can't be used any more."""
    _delete(spark, f"{shared_folder(spark)}/recordloom/{spark.sparkContext.applicationId}")


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again; its shuffle files, of no use any more, are deleted."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: what follows needs neither the plan above nor the executors that ran it, nor its shuffle files.
    """
    path = scratch(df.sparkSession, label)
    if _OPEN:
        _OPEN[-1].append(path)
    return _write(df, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables that :func:`hold` writes within the block at its end; the given function writes ones that stay.

    What leaves the block must not read the deleted ones.
    """
    paths: list[str] = []
    _OPEN.append(paths)

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = scratch(spark, label)
        if len(_OPEN) > 1:
            _OPEN[-2].append(path)
        return _write(df, path)

    try:
        yield keep
    finally:
        _OPEN.remove(paths)
        for path in paths:
            _delete(spark, path)


def drop_held(df: DataFrame) -> None:
    """Delete the files of a table that :func:`hold` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/recordloom/" in folder:
            _delete(spark, folder)


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python functions over Arrow: small batches, and executors that can import this package.

    Batches of texts stay within BATCH_BYTES unless the session says otherwise, as Spark's default of 64 MiB is held
    several times over by a task.  Nothing to ship where PYTHONPATH or the working folder leads to the package; else
    Spark's file server hands out a zip.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    seen = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    sc = spark.sparkContext
    if str(ROOT) in seen | {os.path.realpath(os.getcwd())} or getattr(sc, "_recordloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="recordloom-code-")) / "recordloom_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((ROOT / "recordloom").rglob("*.py")):
            archive.write(source, source.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._recordloom_shipped = True
