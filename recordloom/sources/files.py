"""Listings of media files, and what is inside them."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stems as S
from ..functions import text as X
from ..schema import NOT_FOUND, with_meta
from ..tables import ship

SWAPPED_FOLDER = "song-artist"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")


def scan(listing: DataFrame, known: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Tracks (path, file_types, artist, song) of zip and cdg files; those whose path ``known`` has are left out."""
    ext = F.lower(F.regexp_extract("path", r"(?<=[^/])\.([^./]*)\z", 1))
    media = listing.select("path", ext.alias("_ext")).where(F.col("_ext").isin("zip", "cdg"))
    if known is not None:
        media = media.join(known.select("path"), "path", "left_anti")
    sound = listing.where(F.col("path").endswith(".mp3")).select(X.sub(F.col("path"), r"\.mp3\z").alias("_base")).distinct()
    rows = media.withColumn("_stem_path", X.sub(F.col("path"), r"\.[^./]*\z")).join(sound, F.col("_stem_path") == F.col("_base"), "left")
    types = F.when(F.col("_ext") == "zip", F.array(F.lit("zip"))).when(F.col("_base").isNotNull(), F.array(F.lit("mp3"), F.lit("cdg"))).otherwise(F.array(F.lit("cdg")))
    rows = rows.withColumns({"_p": S.parse_artist_song(X.stem("path")), "_turned": F.array_contains(F.split("path", "/"), SWAPPED_FOLDER)})
    artist = F.when(F.col("_turned"), F.col("_p.song")).otherwise(F.col("_p.artist"))
    song = F.when(F.col("_turned"), F.col("_p.artist")).otherwise(F.col("_p.song"))
    out = rows.select("path", types.alias("file_types"), artist.alias("artist"), song.alias("song"))
    if aliases is not None:
        from ..plans.cleanup import apply_aliases

        out = apply_aliases(out, aliases)
    return out.withColumn("artist", F.when(F.col("artist") == "", "Unknown").otherwise(F.col("artist")))


# ------------------------------------------------------------- mp3 and zip contents

# Fixed values of MPEG audio: kilobits by index, samples a second, samples a frame.
_RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_HERTZ = (44100, 48000, 32000)
# Frames of the tag format, with the two-byte names of its older version.
_FRAMES = {"tag_artist": ("TPE1", "TP1"), "tag_title": ("TIT2", "TT2"), "tag_album": ("TALB", "TAL"), "tag_year": ("TDRC", "TYER", "TYE"), "tag_genre": ("TCON", "TCO"), "tag_key": ("TKEY", "TKE")}


def _safe(data: bytes) -> int:
    return (data[0] << 21) | (data[1] << 14) | (data[2] << 7) | data[3]


def _frame(data: bytes, at: int) -> tuple | None:
    """(version, kbps, hertz, channels, bytes, samples) of the layer III frame at a place."""
    if at + 4 > len(data):
        return None
    head = int.from_bytes(data[at : at + 4], "big")
    version, layer, rate, hertz = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or hertz == 3:
        return None
    kbps = (_RATES_1 if version == 3 else _RATES_2)[rate]
    hz = _HERTZ[hertz] >> (0 if version == 3 else 1 if version == 2 else 2)
    samples = 1152 if version == 3 else 576
    return version, kbps, hz, 1 if head >> 6 & 3 == 3 else 2, samples // 8 * kbps * 1000 // hz + (head >> 9 & 1), samples


def mp3_info(data: bytes) -> dict[str, str]:
    """Length, bit rate, sample rate and channels as texts; empty where no frame is found."""
    start = 10 + _safe(data[6:10]) if data[:3] == b"ID3" and len(data) > 10 else 0
    for at in range(start, min(len(data), start + 65536)):
        first = _frame(data, at)
        if not first or (at + first[4] + 4 <= len(data) and not _frame(data, at + first[4])):
            continue
        version, kbps, hz, channels, _, samples = first
        side = at + 4 + ((32 if channels == 2 else 17) if version == 3 else (17 if channels == 2 else 9))
        audio = len(data) - at - (128 if data[-128:-125] == b"TAG" else 0)
        seconds, rate = audio * 8 / (kbps * 1000), kbps * 1000
        if data[side : side + 4] in (b"Xing", b"Info") and data[side + 7] & 1:
            frames = struct.unpack(">I", data[side + 8 : side + 12])[0]
            size = struct.unpack(">I", data[side + 12 : side + 16])[0] if data[side + 7] & 2 else audio
            seconds = frames * samples / hz
            rate = int(size * 8 / seconds) if seconds else rate
        return {"length_seconds": str(round(seconds, 2)), "bitrate_bps": str(rate), "sample_rate_hz": str(hz), "channels": str(channels)}
    return {}


def mp3_tags(data: bytes) -> dict[str, str]:
    """The six tags; those that aren't there have the value that says so."""
    out = dict.fromkeys(_FRAMES, NOT_FOUND)
    if data[:3] != b"ID3" or len(data) < 10:
        return out
    old, end, at = data[3] == 2, min(len(data), 10 + _safe(data[6:10])), 10
    if data[5] & 0x40 and not old:
        at += _safe(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    names = {frame: tag for tag, frames in _FRAMES.items() for frame in frames}
    while at + (6 if old else 10) <= end and data[at]:
        name = data[at : at + (3 if old else 4)].decode("latin-1")
        size = int.from_bytes(data[at + 3 : at + 6], "big") if old else _safe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        at += 6 if old else 10
        body, at = data[at : at + size], at + size
        if name in names and len(body) > 1 and out[names[name]] == NOT_FOUND:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            value = body[1:].decode(coding, "replace").split("\0")[0].strip()
            out[names[name]] = value or NOT_FOUND
    return out


def pair_details(sound: bytes, cdg_crc: int, cdg_size: int) -> dict[str, str]:
    import hashlib

    found = {"mp3_hash": hashlib.sha256(sound).hexdigest(), "mp3_size": str(len(sound)), "cdg_hash": f"{cdg_crc:08x}", "cdg_size": str(cdg_size)}
    return found | mp3_info(sound) | mp3_tags(sound)


def read_member(archive: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes, also where only its checksum is wrong."""
    try:
        return archive.read(name)
    except zipfile.BadZipFile:
        with archive.open(name) as member:
            member._expected_crc = None
            return member.read()


def zip_details(content: bytes) -> dict[str, str]:
    """Details of the last cdg and the last mp3 in an archive; none where one is lacking, and an error if torn."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = {PurePosixPath(n).suffix.lower(): n for n in archive.namelist() if not n.endswith("/")}
            if ".cdg" not in members or ".mp3" not in members:
                return {}
            picture = archive.getinfo(members[".cdg"])
            return pair_details(read_member(archive, members[".mp3"]), picture.CRC, picture.file_size)
    except NotImplementedError as error:
        return {"error": f"unsupported compression: {error}"}
    except zipfile.BadZipFile as error:
        return {"error": f"bad zip: {error}"}
    except zlib.error as error:
        return {"error": f"decompress failed: {error}"}
    except (OSError, ValueError, RuntimeError, EOFError) as error:
        return {"error": str(error)}


def zip_sound(content: bytes) -> bytes | None:
    """The first mp3 in an archive; None where there is none or it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if n.lower().endswith(".mp3")]
            return read_member(archive, names[0]) if names else None
    except (OSError, ValueError, RuntimeError, EOFError, NotImplementedError, zipfile.BadZipFile, zlib.error):
        return None


DETAILS = T.StructType([T.StructField("path", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))])


def read_details(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, details) of zip and cdg files below a folder; of ``wanted`` (path) only, where that is given."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    zips, pictures = files.where(ext == "zip"), files.where(ext == "cdg")
    if wanted is not None:
        zips, pictures = (x.join(wanted.select("path"), "path", "left_semi") for x in (zips, pictures))
    sounds = files.where(F.col("path").endswith(".mp3")).select(X.sub(F.col("path"), r"\.mp3\z").alias("base"), F.col("content").alias("sound"))
    pairs = pictures.withColumn("base", X.sub(F.col("path"), r"\.[^./]*\z")).join(sounds, "base")
    pairs = pairs.select("path", "sound", F.crc32("content").alias("crc"), F.octet_length("content").alias("size"))

    def of_zips(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "details": [zip_details(c) for c in frame["content"]]})

    def of_pairs(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "details": [pair_details(s, int(c), int(n)) for s, c, n in zip(frame["sound"], frame["crc"], frame["size"], strict=True)]})

    return zips.mapInPandas(of_zips, DETAILS).unionByName(pairs.mapInPandas(of_pairs, DETAILS))


def changed_files(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, src_mtime, src_size) of tracks whose file has another time (in seconds) or size than when last read."""
    now = listing.select("path", F.unix_timestamp("modificationTime").cast("string").alias("src_mtime"), F.col("length").cast("string").alias("src_size"))
    known = with_meta(tracks, "src_mtime", "src_size").select("path", "src_mtime", "src_size")
    return now.join(tracks.select("path"), "path", "left_semi").join(known, ["path", "src_mtime", "src_size"], "left_anti")


def with_details(tracks: DataFrame, details: DataFrame, changed: DataFrame) -> DataFrame:
    """Tracks with new details put in; what the new ones lack stays as it was."""
    names = ("mp3_hash", "mp3_size", "cdg_hash", "cdg_size", "length_seconds", "bitrate_bps", "sample_rate_hz", "channels", *_FRAMES, "error")
    rows = with_meta(tracks, *names, "src_mtime", "src_size")
    side = changed.join(details, "path", "left").select(F.col("path").alias("_path"), F.col("src_mtime").alias("_m"), F.col("src_size").alias("_s"), F.col("details").alias("_d"))
    met = rows.join(side, F.col("path") == F.col("_path"), "left")
    new = {n: F.coalesce(F.try_element_at("_d", F.lit(n)), F.col(n)) for n in names} | {"src_mtime": F.coalesce("_m", "src_mtime"), "src_size": F.coalesce("_s", "src_size")}
    return met.withColumns(new).select(*rows.columns)
