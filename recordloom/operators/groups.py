"""Groups of tracks by artist and title, and what is picked from them.

Picks are aggregates (``min_by`` over an order), so a group of any size is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def keyed(tracks: DataFrame) -> DataFrame:
    """``tracks`` with ``artist_key``, ``song_key`` and ``letter``; nulls count as empty."""
    out = tracks.withColumns({
        "artist_key": X.clean_artist(F.coalesce("artist", F.lit(""))),
        "song_key": X.clean_song(F.coalesce("song", F.lit(""))),
    })
    return out.withColumn("letter", X.letter("artist_key"))


def title_order() -> Column:
    return F.concat(F.coalesce("artist", F.lit("")), F.lit(" - "), F.coalesce("song", F.lit("")))


def artist_counts(tracks: DataFrame) -> DataFrame:
    """(artist_key, n): tracks of each artist."""
    return keyed(tracks).groupBy("artist_key").agg(F.count(F.lit(1)).alias("n"))


def known_artists(tracks: DataFrame, more_than: int = 1) -> DataFrame:
    """(artist_key): artists with more tracks than that; the empty name isn't one, 'unknown' is."""
    return artist_counts(tracks).where((F.col("artist_key") != "") & (F.col("n") > more_than)).select("artist_key")


def thin_artists(tracks: DataFrame, at_most: int = 5) -> DataFrame:
    """(artist_key, n): artists with that many tracks at most."""
    return artist_counts(tracks).where(F.col("n") <= at_most)


def flag_known(df: DataFrame, key: Column, known: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column: whether ``key`` is among the known artists."""
    side = known.select(F.col("artist_key").alias(f"_{flag}")).distinct()
    return df.join(side, key == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")


def single_artist_reps(tracks: DataFrame, max_songs: int = 3) -> DataFrame:
    """The first track by title order of each song of artists with ``max_songs`` tracks at most."""
    rows = keyed(tracks)
    thin = thin_artists(tracks, max_songs).select(F.col("artist_key").alias("_thin"))
    few = rows.join(thin, F.col("artist_key") == F.col("_thin"), "left_semi")
    w = Window.partitionBy("artist_key", "song_key").orderBy(title_order(), "ord")  # max_songs rows at most
    return few.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def majority(df: DataFrame, keys: list[str], value: str, order: str = "ord") -> DataFrame:
    """(*keys, value, n): the most frequent non-empty value of each group; of equals the one seen first."""
    counted = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_o").alias("o"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(value), (-F.col("_b.n")).alias("n"))


def best_copy(tracks: DataFrame) -> DataFrame:
    """The track with the largest mp3 of each (artist_key, song_key); of equals the first by title order."""
    rows = keyed(tracks)
    order = F.struct((-X.whole("mp3_size")).alias("s"), title_order().alias("t"), F.col("ord").alias("o"))
    names = [c for c in rows.columns if c not in ("artist_key", "song_key")]
    best = rows.groupBy("artist_key", "song_key").agg(F.min_by(F.struct(*names), order).alias("_b"))
    return best.select(*[F.col(c) if c in ("artist_key", "song_key") else F.col(f"_b.{c}") for c in rows.columns])


def ranked_versions(tracks: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best tracks of each (artist_key, song_key) with their ``rank``, largest mp3 first."""
    w = Window.partitionBy("artist_key", "song_key").orderBy(X.whole("mp3_size").desc(), title_order(), "ord")
    # Spark keeps the first ranks of each partition before it shuffles.
    return keyed(tracks).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def subtree_counts(tracks: DataFrame) -> DataFrame:
    """(level, letter, artist_key, song_key, n): tracks below each node of the letter-artist-song tree."""
    out = keyed(tracks).rollup("letter", "artist_key", "song_key").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 7, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 1, 2).otherwise(3)
    return out.select(level.cast("int").alias("level"), "letter", "artist_key", "song_key", "n")


def song_index(tracks: DataFrame) -> DataFrame:
    """(letter, song_key, artist, n): tracks by title, then raw artist; unknown artists are left out."""
    rows = tracks.where(~X.is_unknown(F.coalesce("artist", F.lit("")))).withColumn("song_key", X.clean_song(F.coalesce("song", F.lit(""))))
    return rows.groupBy(X.letter("song_key").alias("letter"), "song_key", "artist").agg(F.count(F.lit(1)).alias("n"))


def folder_counts(tracks: DataFrame) -> DataFrame:
    """(folder, n): tracks in or below each folder of their paths."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = tracks.select(F.explode(F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))).alias("folder"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def browse(tracks: DataFrame, letter: str | None = None, artist_key: str | None = None) -> DataFrame:
    """(name, n): one level of the tree: letters, a letter's artists or an artist's songs, in order."""
    rows = keyed(tracks)
    if letter is not None:
        rows = rows.where(F.col("letter") == letter)
    if artist_key is not None:
        rows = rows.where(F.col("artist_key") == artist_key)
    level = "letter" if letter is None else "artist_key" if artist_key is None else "song_key"
    return rows.groupBy(F.col(level).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy("name")
