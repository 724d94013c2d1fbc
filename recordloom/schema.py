"""Columns of a track record.

A frame of tracks has the core columns and any of the metadata columns; one that a frame lacks counts as null.
``ord`` is the order in which records came in, which decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("file_types", T.ArrayType(T.StringType())),
    T.StructField("artist", T.StringType()),
    T.StructField("song", T.StringType()),
])

#: The metadata keys of the exchange format.
METADATA = (
    "mp3_hash", "mp3_size", "cdg_hash", "cdg_size",
    "length_seconds", "bitrate_bps", "sample_rate_hz", "channels",
    "tag_artist", "tag_title", "tag_album", "tag_year", "tag_genre", "tag_key",
    "src_mtime", "src_size", "error", "style", "track_no", "catalog_id", "feature",
    "artist_from", "artist_review", "artist_review_reason",
    "mb_checked", "mb_match", "mb_artist", "mb_title", "restitch",
    "key", "key_confidence", "key_source", "key_detail", "key_sig", "key_camelot",
)

STORED = T.StructType([*CORE.fields, T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
NOT_FOUND = "<not-found>"


def meta(df: DataFrame, name: str) -> Column:
    """A metadata column; null where the frame has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def with_meta(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named metadata columns, null where it lacked them."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def from_stored(df: DataFrame) -> DataFrame:
    """Records with a metadata map, as files hold them, to columns; missing fields get their defaults."""
    blank = {"artist": F.lit(""), "song": F.lit(""), "file_types": F.array().cast("array<string>")}
    out = df.withColumns({k: F.coalesce(F.col(k), v) for k, v in blank.items()})
    found = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("map<string,string>")
    return out.withColumns({n: F.nullif(F.try_element_at(found, F.lit(n)), F.lit(NOT_FOUND)) for n in METADATA}).drop("metadata")


def to_stored(df: DataFrame) -> DataFrame:
    """Columns to records with a metadata map; null entries are left out."""
    names = [n for n in METADATA if n in df.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names]) if names else F.array().cast("array<struct<k:string,v:string>>")
    found = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return df.select("path", "file_types", "artist", "song", found.alias("metadata"))
