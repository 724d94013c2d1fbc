"""Review: which tracks are looked at, what settles them, and edits.

Review state is a frame (path, status); passes that settle tracks return those paths as a second frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import groups
from ..schema import meta, with_meta


def review_queue(tracks: DataFrame, state: DataFrame, always: DataFrame | None = None, at_most: int = 5) -> DataFrame:
    """Tracks of artists with few tracks, or named in ``always`` (artist), that aren't marked ok."""
    rows = groups.keyed(tracks)
    listed = groups.thin_artists(tracks, at_most).select("artist_key")
    if always is not None:
        listed = listed.unionByName(always.select(X.clean_artist("artist").alias("artist_key"))).distinct()
    thin = rows.join(listed.withColumnRenamed("artist_key", "_k"), F.col("artist_key") == F.col("_k"), "left_semi")
    done = state.where("status = 'ok'").select(F.col("path").alias("_done"))
    return thin.join(done, F.col("path") == F.col("_done"), "left_anti").select(*tracks.columns)


def mark(state: DataFrame, paths: DataFrame, status: str = "ok") -> DataFrame:
    """``state`` with ``status`` for the given paths."""
    new = paths.select("path").distinct().withColumn("status", F.lit(status))
    return state.join(new, "path", "left_anti").unionByName(new)


def with_song_as_artist(tracks: DataFrame, known: DataFrame) -> DataFrame:
    """``tracks`` with ``_flip``: the artist that the title names, turned around first; null if none is known."""
    rows = tracks.withColumn("_turned", X.uncomma_artist("song"))
    rows = groups.flag_known(rows, X.clean_artist("_turned"), known, "_turned_known")
    rows = groups.flag_known(rows, X.clean_artist("song"), known, "_song_known")
    flip = F.when(F.col("_turned_known"), F.col("_turned")).when(F.col("_song_known"), F.col("song"))
    return rows.withColumn("_flip", flip).drop("_turned", "_turned_known", "_song_known")


def _tag(rows: DataFrame) -> Column:
    """Tokens of the artist tag; empty where there is none."""
    return X.artist_tokens(F.nullif(meta(rows, "tag_artist"), F.lit("<not-found>")))


def settle_by_tags(tracks: DataFrame, state: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """(path): tracks in review whose artist tag has the artist's words, unless they look swapped."""
    known = groups.known_artists(tracks, 3)
    rows = with_song_as_artist(review_queue(tracks, state, always), known)
    rows = groups.flag_known(rows, X.clean_artist("artist"), known, "_artist_known")
    own = X.artist_tokens("artist")
    agree = (F.size(own) > 0) & (own == _tag(rows))
    return rows.where(agree & (F.col("_artist_known") | F.col("_flip").isNull())).select("path")


def swap_by_tags(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks with artist and song changed places where the song is a known artist and the tag or a comma says so;
    and the paths of those, which count as reviewed."""
    known = groups.known_artists(tracks, 3)
    rows = with_song_as_artist(tracks, known)
    rows = groups.flag_known(rows, X.clean_artist("artist"), known, "_artist_known")
    rows = rows.withColumn("_tag", _tag(rows))
    comma, tagged = F.col("_flip") != F.col("song"), F.size("_tag") > 0
    veto = ~comma & tagged & (F.col("_tag") == X.artist_tokens("artist"))
    says = tagged & (F.col("_tag") == X.artist_tokens("song"))
    open_ = ~X.is_unknown("artist") & (F.col("song") != "") & ~F.col("artist").contains("\\") & ~F.col("_artist_known")
    rows = rows.withColumn("_swap", F.coalesce(open_ & F.col("_flip").isNotNull() & ~veto & (says | comma), F.lit(False)))
    swapped = rows.withColumns({"artist": F.when(F.col("_swap"), F.col("_flip")).otherwise(F.col("artist")), "song": F.when(F.col("_swap"), F.col("artist")).otherwise(F.col("song"))})
    return swapped.select(*tracks.columns), rows.where("_swap").select("path")


def apply_resolutions(tracks: DataFrame, state: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks with the artist and song of ``resolutions`` (path, artist, song), null leaving a field alone; and the
    paths that were changed or newly reviewed.  Those already so keep their provenance."""
    rows = with_meta(tracks, "artist_from")
    given = resolutions.groupBy("path").agg(F.max_by(F.struct("artist", "song"), F.struct("artist", "song")).alias("r"))
    side = given.select(F.col("path").alias("_path"), F.col("r.artist").alias("_artist"), F.col("r.song").alias("_song"))
    done = state.where("status = 'ok'").select(F.col("path").alias("_done"))
    met = rows.join(side, F.col("path") == F.col("_path"), "left").join(done, F.col("path") == F.col("_done"), "left")
    artist, song = F.coalesce("_artist", "artist"), F.coalesce("_song", "song")
    changed = ~artist.eqNullSafe(F.col("artist")) | ~song.eqNullSafe(F.col("song"))
    met = met.withColumn("_apply", F.col("_path").isNotNull() & (changed | F.col("_done").isNull()))
    out = met.withColumns({"artist": artist, "song": song, "artist_from": F.when(F.col("_apply"), "resolutions").otherwise(F.col("artist_from"))})
    return out.select(*rows.columns), met.where("_apply").select("path")


def resolution_report(tracks: DataFrame, state: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(path, outcome, old_artist, old_song, new_artist, new_song): a dry run; outcome is apply, unchanged or missing."""
    here = tracks.select(F.col("path").alias("_path"), F.col("artist").alias("old_artist"), F.col("song").alias("old_song"))
    done = state.where("status = 'ok'").select(F.col("path").alias("_done"))
    met = resolutions.join(here, F.col("path") == F.col("_path"), "left").join(done, F.col("path") == F.col("_done"), "left")
    artist, song = F.coalesce("artist", "old_artist"), F.coalesce("song", "old_song")
    same = artist.eqNullSafe(F.col("old_artist")) & song.eqNullSafe(F.col("old_song"))
    outcome = F.when(F.col("_path").isNull(), "missing").when(same & F.col("_done").isNotNull(), "unchanged").otherwise("apply")
    return met.select("path", outcome.alias("outcome"), "old_artist", "old_song", artist.alias("new_artist"), song.alias("new_song"))


def apply_edits(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Tracks after a log of ``edits`` (path, op, value, ts), in order of ts.

    Ops: swap; artist and song set a field, empty values leaving it; unset-artist; auto-clean splits a credit; accept
    takes the suggested artist and title where they differ by more than marks; tag-accept takes the tag's artist.
    A track's edits are folded one after the other, so their number a track should be small.
    """
    rows = with_meta(tracks, "feature", "mb_artist", "mb_title", "tag_artist")
    log = edits.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("ts", "op", F.coalesce("value", F.lit("")).alias("value")))).alias("_log"))
    met = rows.join(log, F.col("path") == F.col("_path"), "left")
    tagged = X.query_form("tag_artist", uncomma=True)
    start = F.struct(F.col("artist").alias("artist"), F.col("song").alias("song"), F.col("feature").alias("feature"))

    def step(s: Column, e: Column) -> Column:
        op, value = e["op"], e["value"]
        cleaned = X.auto_clean_artist(s["artist"])
        suggested = (op == "accept") & (F.coalesce("mb_artist", F.lit("")) != "")
        title = F.coalesce("mb_title", F.lit(""))
        artist = (
            F.when(op == "swap", s["song"]).when((op == "artist") & (value != ""), value).when(op == "unset-artist", "")
            .when(op == "auto-clean", cleaned["artist"]).when(suggested & ~X.norm_eq("mb_artist", s["artist"]), F.col("mb_artist"))
            .when((op == "tag-accept") & (tagged != ""), tagged).otherwise(s["artist"])
        )
        song = F.when(op == "swap", s["artist"]).when((op == "song") & (value != ""), value).when(suggested & (title != "") & ~X.norm_eq(title, s["song"]), title).otherwise(s["song"])
        feature = F.when(op == "auto-clean", F.coalesce(F.nullif(cleaned["feature"], F.lit("")), s["feature"])).otherwise(s["feature"])
        return F.struct(artist.alias("artist"), song.alias("song"), feature.alias("feature"))

    met = met.withColumn("_end", F.when(F.col("_log").isNotNull(), F.aggregate("_log", start, step)).otherwise(start))
    return met.withColumns({c: F.col(f"_end.{c}") for c in ("artist", "song", "feature")}).select(*rows.columns)
