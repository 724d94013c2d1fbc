"""Stores: the exchange files, and table snapshots for large libraries."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import STORED, from_stored, to_stored

VERSION = 1
REVIEW = "path string, status string"


def _document(path: str, what: str) -> dict:
    with open(path, encoding="utf-8") as src:
        data = json.load(src)
    if data.get("version", VERSION) != VERSION:
        raise ValueError(f"unsupported {what} version {data['version']}")
    return data


def _save(path: str, data: dict) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".tmp")
    part.write_text(json.dumps(data, indent=2), encoding="utf-8")
    os.replace(part, target)


def load_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of an exchange file, the last one of a path at the place of the first; none where the file is absent.

    Another version, or a file that can't be read, raises.
    """
    if not Path(path).exists():
        return from_stored(spark.createDataFrame([], STORED)).withColumn("ord", F.lit(0).cast("long"))
    _document(path, "store")  # one file, written by one process: it fits here
    schema = T.StructType([T.StructField("tracks", T.ArrayType(STORED))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(F.posexplode("tracks").alias("ord", "t")).select(F.col("ord").cast("long").alias("ord"), "t.*")
    rows = rows.where(F.col("path").isNotNull() | F.raise_error(F.lit("a track without a path")).isNotNull())
    return from_stored(upsert(rows.limit(0), rows))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by path: the last by ``ord`` of the new ones, else of the old; a path keeps its first ``ord``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("path", "ord", "_new")]
    best = both.groupBy("path").agg(F.max_by(F.struct(*names), F.struct("_new", "ord")).alias("r"), F.min_by("ord", F.struct("_new", "ord")).alias("ord"))
    return best.select("path", *[F.col(f"r.{c}").alias(c) for c in names], "ord")


def save_tracks(tracks: DataFrame, path: str) -> None:
    """Write an exchange file, row by row and then in place of the old one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".tmp")
    ordered = tracks.orderBy("ord") if "ord" in tracks.columns else tracks
    lines = to_stored(ordered).select(F.to_json(F.struct("*")).alias("j"))
    with part.open("w", encoding="utf-8") as out:
        out.write('{"version": 1, "tracks": [')
        for n, row in enumerate(lines.toLocalIterator()):
            out.write((",\n" if n else "\n") + row["j"])
        out.write("\n]}\n")
    os.replace(part, target)


def load_review(spark: SparkSession, path: str) -> DataFrame:
    """(path, status) of a review file; none where it is absent, another version raises."""
    by_path = _document(path, "review").get("by_path", {}) if Path(path).exists() else {}
    return spark.createDataFrame(list(by_path.items()), REVIEW)


def save_review(state: DataFrame, path: str) -> None:
    _save(path, {"version": VERSION, "by_path": {r["path"]: r["status"] for r in state.orderBy("path").toLocalIterator()}})


def load_mapping(spark: SparkSession, path: str, key: str, names: tuple[str, str]) -> DataFrame:
    """Two columns of a JSON side file, from its field ``key`` or, lacking that, all of it; nothing if unreadable."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        data = {}
    pairs = data.get(key, {} if "version" in data else data) if isinstance(data, dict) else {}
    rows = [(k, v) for k, v in pairs.items() if isinstance(v, str)] if isinstance(pairs, dict) else []
    return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string")


def load_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """(path, artist, song, why) of a resolutions file; fields that an entry lacks are null."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8")).get("resolutions", {})
    except (OSError, ValueError):
        data = {}
    rows = [(k, r.get("artist"), r.get("song"), r.get("why")) for k, r in data.items()]
    return spark.createDataFrame(rows, "path string, artist string, song string, why string")


def load_config(path: str) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def save_config(config: dict, path: str) -> None:
    _save(path, config)


class Snapshots:
    """A table as Parquet snapshots in a folder; numbered pointer files name them, and the highest is the current one.

    A snapshot is written whole before its pointer gets its name by one rename, and no pointer is deleted before a later
    one is there: a reader, or a writer that takes up after a crash at any step, finds the last whole snapshot.  Two
    writers that commit at once don't overwrite each other: the later rename fails.
    """

    #: Snapshots that stay for readers that are still at work.
    KEEP = 3

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, name of the snapshot), in order; both are in the pointer's name."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted((int(n.split(".")[1]), n.split(".")[2]) for n in names if n.startswith("current."))

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1][1] if pointers else None

    def read(self) -> DataFrame | None:
        name = self.current()
        return self.spark.read.parquet(f"{self.folder}/{name}") if name else None

    def _move(self, part, pointer) -> None:
        if not self._fs.rename(part, pointer):
            raise OSError("the pointer could not be moved")

    def commit(self, df: DataFrame) -> str:
        """Write ``df`` as the new current snapshot and return its name."""
        pointers = self._pointers()
        number = pointers[-1][0] + 1 if pointers else 0
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        part = self._path(f"{self.folder}/.part-{name}")
        self._fs.create(part, True).close()
        if any(n >= number for n, _ in self._pointers()):
            raise OSError("another writer has committed")
        self._move(part, self._path(f"{self.folder}/current.{number:012d}.{name}"))
        for n, old in pointers[: max(0, len(pointers) + 1 - self.KEEP)]:
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)
            self._fs.delete(self._path(f"{self.folder}/current.{n:012d}.{old}"), False)
        return name
