"""What the corpus operators share: tables in the shared folder, file access, Arrow columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..tables import drop_held, hold, scratch, ship, tidy

__all__ = ["drop_held", "filesystem", "free_name", "hold", "raw", "read_file", "scratch", "ship", "table", "tidy", "write_file"]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem of a URI and the path inside it; usable on driver and executors alike."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> None:
    """Write byte strings to ``uri`` by way of a private name, so that a lost or repeated task leaves no torn file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(private, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(private, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as src:
        return src.read()


def raw(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column's rows, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df_columns, wanted: str) -> str:
    """``wanted``, or with underscores before it where the columns already have that name."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
