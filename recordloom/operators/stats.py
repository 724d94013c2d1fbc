"""Statistics of a library, each a small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import meta
from .groups import keyed, majority


def _named(tracks: DataFrame) -> DataFrame:
    return keyed(tracks).where(~X.is_unknown(F.coalesce("artist", F.lit(""))))


def _beside(*rows: DataFrame) -> DataFrame:
    """One row of the columns of frames of one row each."""
    both = rows[0]
    for row in rows[1:]:
        both = both.unionByName(row, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def distinct_pairs(tracks: DataFrame) -> DataFrame:
    """One row: ``pairs`` distinct artist and song keys of named artists, ``files`` in all."""
    pairs = _named(tracks).select("artist_key", "song_key").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    return _beside(pairs, tracks.agg(F.count(F.lit(1)).alias("files")))


def library_totals(tracks: DataFrame) -> DataFrame:
    """One row of totals over all files, and over pairs of named artists with a title."""
    unknown = X.is_unknown(F.coalesce("artist", F.lit("")))
    length, rate = meta(tracks, "length_seconds"), X.number(meta(tracks, "bitrate_bps"))
    files = tracks.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(unknown).alias("unknown"),
        F.sum(X.number(length)).alias("seconds"),
        F.sum(X.number(meta(tracks, "mp3_size")) + X.number(meta(tracks, "cdg_size"))).alias("bytes"),
        F.count_if(F.coalesce(length, F.lit("")) != "").alias("detailed"),
        F.sum(rate).alias("_rates"),
        F.count_if(rate != 0).alias("_rated"),
    )
    pairs = _named(tracks).where("song_key <> ''").groupBy("artist_key", "song_key").agg(F.count(F.lit(1)).alias("n"))
    artists = pairs.groupBy("artist_key").agg(F.count(F.lit(1)).alias("songs"), F.sum(F.col("n") - 1).alias("extra"))
    kinds = artists.agg(F.coalesce(F.sum("songs"), F.lit(0)).alias("distinct_songs"), F.count(F.lit(1)).alias("distinct_artists"), F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))
    both = _beside(files, kinds)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return both.select(
        "files", "distinct_songs", "distinct_artists", "unknown", "duplicates", zero("seconds").alias("seconds"), zero("bytes").alias("bytes"), "detailed",
        F.when(F.col("detailed") > 0, F.expr("seconds div detailed")).alias("avg_seconds"),
        F.when(F.col("_rated") > 0, F.expr("(_rates div _rated) div 1000")).alias("avg_kbps"),
    )


def format_breakdown(tracks: DataFrame) -> DataFrame:
    return tracks.select(F.explode("file_types").alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def decades(tracks: DataFrame) -> DataFrame:
    y = X.year(meta(tracks, "tag_year"))
    return tracks.where(y.isNotNull()).groupBy((F.floor(y / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def top_artists(tracks: DataFrame, limit: int = 15) -> DataFrame:
    """(artist, songs): artists with the most distinct songs, in their commonest spelling; ties as seen first."""
    rows = _named(tracks).where("song_key <> ''")
    songs = rows.groupBy("artist_key", "song_key").agg(F.min("ord").alias("o")).groupBy("artist_key").agg(F.count(F.lit(1)).alias("songs"), F.min("o").alias("o"))
    top = songs.orderBy(F.desc("songs"), "o").limit(limit)
    named = majority(rows, ["artist_key"], "artist").drop("n")
    return top.join(named, "artist_key").select("artist", "songs", "o").orderBy(F.desc("songs"), "o").drop("o")


def most_duplicated(tracks: DataFrame, limit: int = 10) -> DataFrame:
    """(title, copies): pairs with the most copies, two at least, as first seen; ties as seen first."""
    rows = _named(tracks).where("song_key <> ''").withColumn("title", F.concat("artist", F.lit(" - "), F.coalesce("song", F.lit(""))))
    pairs = rows.groupBy("artist_key", "song_key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("ord", "title")).alias("f"))
    return pairs.where("copies >= 2").orderBy(F.desc("copies"), "f.ord").limit(limit).select(F.col("f.title").alias("title"), "copies")


def alias_usage(tracks: DataFrame, aliases: DataFrame, limit: int = 80) -> DataFrame:
    """(variant, canonical, n): how many tracks each alias would rename, the commonest first."""
    used = tracks.groupBy(F.col("artist").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    return used.join(aliases, "variant").orderBy(F.desc("n"), "o").limit(limit).select("variant", "canonical", "n")


def report(tracks: DataFrame) -> list[str]:
    """The statistics as lines of text; each comes from a few rows."""
    t = library_totals(tracks).first()
    if not t["files"]:
        return ["The library is empty."]
    hours = tracks.sparkSession.range(1).select(X.hours(F.lit(t["seconds"])).alias("h")).first()["h"]
    formats = sorted(format_breakdown(tracks).collect(), key=lambda r: (-r["n"], r["format"]))
    lines = [
        f"Files: {t['files']:,}", f"Distinct songs: {t['distinct_songs']:,}", f"Distinct artists: {t['distinct_artists']:,}", f"Files of unknown artists: {t['unknown']:,}",
        f"Extra copies: {t['duplicates']:,} ({t['duplicates'] / t['files']:.0%} of files)", "Formats: " + ", ".join(f"{r['format']}={r['n']:,}" for r in formats),
        f"With details: {t['detailed']:,}", f"Total audio: {hours}", f"Total size: {t['bytes'] / 1e9:,.1f} GB",
    ]
    if t["avg_seconds"] is not None:
        lines.append(f"Mean length: {t['avg_seconds'] // 60}m {t['avg_seconds'] % 60}s")
    if t["avg_kbps"] is not None:
        lines.append(f"Mean bit rate: {t['avg_kbps']} kbps")
    lines += [f"{i:>4}. {r['artist']}: {r['songs']:,} songs" for i, r in enumerate(top_artists(tracks).collect(), 1)]
    lines += [f"{r['copies']:>4} copies of {r['title']}" for r in most_duplicated(tracks).collect()]
    return lines + [f"{r['decade']}s: {r['n']:,}" for r in decades(tracks).orderBy("decade").collect()]
