"""Cleanup passes.  Each takes a frame of tracks and returns one with the same rows; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stems as S
from ..functions import text as X
from ..operators import fuzzy, groups
from ..schema import with_meta
from ..tables import hold

# Descriptors that are cut out of names, in the order they are tried.
ARTIST_DESCRIPTORS = (
    "(Wobgv)", "(Wbgv)", "(Bgv)", "wBGV", "Wobgv", "(Wvocals)", "Wvocals", "wvocals", "Wvocal", "wvocal", "W-Vocal",
    "W-vocal", "w-vocal", " w vocal", "vocals", "Wmusic", "wmusic", "()", "(duet)", "(Duet)", "(Solo)", "(solo)",
    "Music Only", "(Instrumental)", "(Explicit Implied)", "(Explicit)", "(Clean)", "Christmas-",
)
SONG_DESCRIPTORS = (
    "( Instrumental )", "(Explicit Implied)", "(Explicit Version)", "(Explicit)", "(Clean)", "(Clean Version)",
    "(Duet)", "(Solo)", "(Solo Male)", "(Instrumental version)", "(Music Only)", "(Wobgv)", "W-Vocal", "Wvocals",
    "Wvocal", "wvocal", "Multiplex",
)


def _texts(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("artist", "song")})


def drop_descriptors(tracks: DataFrame) -> DataFrame:
    """The first artist descriptor and all song descriptors cut out; the last one is the ``style``."""
    rows = with_meta(_texts(tracks), "style")
    first = F.get(F.filter(F.array(*[F.lit(d) for d in ARTIST_DESCRIPTORS]), lambda d: F.contains(F.col("artist"), d)), F.lit(0))

    def cut(state: Column, d: Column) -> Column:
        hit = F.contains(state["song"], d)
        return F.struct(F.when(hit, X.strip(F.replace(state["song"], d, F.lit("")))).otherwise(state["song"]).alias("song"), F.when(hit, d).otherwise(state["style"]).alias("style"))

    rows = rows.withColumn("_first", first)
    start = F.struct(F.col("song").alias("song"), F.coalesce("_first", "style").alias("style"))
    rows = rows.withColumn("_cut", F.aggregate(F.array(*[F.lit(d) for d in SONG_DESCRIPTORS]), start, cut))
    artist = F.when(F.col("_first").isNotNull(), X.strip(F.replace(F.col("artist"), F.col("_first"), F.lit("")))).otherwise(F.col("artist"))
    return rows.withColumns({"artist": artist, "song": F.col("_cut.song"), "style": F.col("_cut.style")}).drop("_first", "_cut")


def drop_matches(tracks: DataFrame, pattern: str) -> DataFrame:
    """What matches cut out of artist and song; the first match of the last one that has any is the ``style``."""
    rows = with_meta(_texts(tracks), "style")
    found = {c: F.regexp_extract(F.col(c), pattern, 0) for c in ("artist", "song")}
    tidy = {c: X.strip(X.sub(X.sub(F.col(c), pattern), rf"{X.SPACE}{{2,}}", " ")) for c in found}
    style = F.when(found["song"] != "", X.strip(found["song"])).when(found["artist"] != "", X.strip(found["artist"])).otherwise(F.col("style"))
    return rows.withColumns({c: F.when(found[c] != "", tidy[c]).otherwise(F.col(c)) for c in found} | {"style": style})


def clear_bogus_artists(tracks: DataFrame) -> DataFrame:
    """Track numbers, catalog paths and empty artists become Unknown; what they were is kept."""
    rows = with_meta(_texts(tracks), "track_no", "catalog_id")
    name = X.strip("artist")
    number, path = name.rlike(r"^\p{Nd}{1,2}\z"), name.contains("\\")
    bogus = (F.lower(name) != "unknown") & (number | path | (name == ""))
    parts = F.split(X.stem("path"), " - ")
    catalog = F.when(bogus & number & (F.size(parts) >= 3), X.strip(parts[0])).when(bogus & ~number & path, F.coalesce(F.col("catalog_id"), name)).otherwise(F.col("catalog_id"))
    return rows.withColumns({"track_no": F.when(bogus & number, name).otherwise(F.col("track_no")), "catalog_id": catalog, "artist": F.when(bogus, "Unknown").otherwise(F.col("artist"))})


def drop_echoes(tracks: DataFrame) -> DataFrame:
    rows = _texts(tracks)
    fixed = F.when(~X.is_unknown("artist"), X.strip_artist_echo("artist", "song"))
    return rows.withColumn("song", F.coalesce(fixed, F.col("song")))


def reparse_catalog_songs(tracks: DataFrame) -> DataFrame:
    """Titles that are the catalog id at the end of their stem are read again from it."""
    rows = with_meta(_texts(tracks), "catalog_id")
    own = X.strip("song")
    parts = S.segments(X.stem("path"))
    ending = (own == F.try_element_at(parts, F.lit(-1))) | F.coalesce(own == F.try_element_at(parts, F.lit(-2)), F.lit(False))
    again = S.parse_artist_song(X.stem("path"))
    rows = rows.withColumns({"_again": again, "_ending": F.coalesce(S.is_catalog_segment("song", True) & ending, F.lit(False))})
    new_artist, new_song = F.col("_again.artist"), F.col("_again.song")
    fix = F.col("_ending") & (new_song != "") & (new_song != F.col("song")) & ~S.is_catalog_segment(new_song, True)
    artist = F.when(new_artist != "", new_artist).when(X.norm_eq("artist", new_song), "Unknown").otherwise(F.col("artist"))
    return rows.withColumns({
        "catalog_id": F.when(fix, F.coalesce(F.col("catalog_id"), own)).otherwise(F.col("catalog_id")),
        "artist": F.when(fix, artist).otherwise(F.col("artist")), "song": F.when(fix, new_song).otherwise(F.col("song")),
    }).drop("_again", "_ending")


def clean(tracks: DataFrame) -> DataFrame:
    """All six row-wise cleanups in their order."""
    out = drop_descriptors(tracks)
    out = drop_matches(drop_matches(out, X.KARAOKE_BRACKET), X.TECHNICAL_PAREN)
    return reparse_catalog_songs(drop_echoes(clear_bogus_artists(out)))


def fix_trailing_articles(tracks: DataFrame) -> DataFrame:
    return _texts(tracks).withColumns({c: X.fix_trailing_article(c) for c in ("artist", "song")})


def fill_from_tags(tracks: DataFrame) -> DataFrame:
    """Unknown artists from their tags; tags that may be junk are only noted."""
    rows = with_meta(_texts(tracks), "tag_artist", "artist_from", "artist_review", "artist_review_reason")
    name = X.strip(X.sub(F.coalesce("tag_artist", F.lit("")), X.TAG_SUFFIX))
    open_ = X.is_unknown(X.strip("artist")) & (F.coalesce("tag_artist", F.lit("")) != "<not-found>") & (name != "")
    reason = F.when(name.rlike(r"^\p{Nd}+\z"), "numeric").when(name.rlike(r"^[A-Za-z]+\p{Nd}{2,}\z"), "catalog-id")
    doubtful, sure = open_ & reason.isNotNull(), open_ & reason.isNull()
    return rows.withColumns({
        "artist": F.when(sure, name).otherwise(F.col("artist")), "artist_from": F.when(sure, "tag").otherwise(F.col("artist_from")),
        "artist_review": F.when(doubtful, name).otherwise(F.col("artist_review")), "artist_review_reason": F.when(doubtful, reason).otherwise(F.col("artist_review_reason")),
    })


def usable_aliases(aliases: DataFrame) -> DataFrame:
    """(variant, canonical) without empty and identical ones; of a variant named twice, the larger canonical name."""
    rows = aliases.where((F.coalesce("variant", F.lit("")) != "") & (F.coalesce("canonical", F.lit("")) != "") & (F.col("variant") != F.col("canonical")))
    return rows.groupBy("variant").agg(F.max("canonical").alias("canonical"))


def apply_aliases(tracks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Artists that are exactly a variant get the canonical name."""
    side = usable_aliases(aliases).withColumnRenamed("variant", "_v").withColumnRenamed("canonical", "_c")
    return tracks.join(side, F.col("artist") == F.col("_v"), "left").withColumn("artist", F.coalesce("_c", "artist")).drop("_v", "_c")


def uncomma_artists(tracks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """'Last, First' turned around where an alias says so or the turned name is an artist of more than one track."""
    rows = _texts(tracks).withColumn("_turned", X.uncomma_artist("artist"))
    rows = groups.flag_known(rows, X.clean_artist("_turned"), groups.known_artists(tracks), "_is_known")
    target = F.when(F.col("_is_known"), F.col("_turned"))
    if aliases is not None:
        side = usable_aliases(aliases).withColumnRenamed("variant", "_v").withColumnRenamed("canonical", "_c")
        rows = rows.join(side, F.col("artist") == F.col("_v"), "left")
        target = F.coalesce("_c", target)
    return rows.withColumn("artist", F.coalesce(target, "artist")).drop("_turned", "_is_known", "_v", "_c")


def _update(tracks: DataFrame, changes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``tracks`` with columns replaced where ``changes`` (path, ...) has a row of their path."""
    side = changes.select(F.col("path").alias("_path"), *[F.col(v).alias(f"_new_{k}") for k, v in columns.items()])
    met = tracks.join(side, F.col("path") == F.col("_path"), "left")
    new = {k: F.when(F.col("_path").isNotNull(), F.col(f"_new_{k}")).otherwise(F.col(k)) for k in columns}
    return met.withColumns(new).drop("_path", *[f"_new_{k}" for k in columns])


def ungroup_artists(tracks: DataFrame, all_copies: bool = False) -> DataFrame:
    """'A & B' of artists with nine tracks at most becomes A, in its commonest spelling, where A is an artist of more
    than one track; B is the ``feature``.  One track of each song changes; with ``all_copies`` every one does."""
    rows = with_meta(_texts(tracks), "feature")
    if all_copies:
        thin = groups.thin_artists(rows, 9).select(F.col("artist_key").alias("_thin"))
        reps = groups.keyed(rows).join(thin, F.col("artist_key") == F.col("_thin"), "left_semi")
    else:
        reps = groups.single_artist_reps(rows, 9)
    reps = reps.where(F.contains(F.col("artist"), F.lit("&")))
    parts = F.split("artist", "&", 2)
    prefix = X.clean_artist(parts[0])
    reps = reps.select("path", F.coalesce(X.uncomma_artist(prefix), prefix).alias("_prefix"), X.strip(parts[1]).alias("_feature"))
    keyed = groups.keyed(rows)
    spelled = groups.majority(keyed, ["artist_key"], "artist").join(groups.known_artists(rows), "artist_key", "left_semi")
    changes = reps.join(spelled.withColumnRenamed("artist", "_artist"), F.col("_prefix") == F.col("artist_key"))
    return _update(rows, changes, {"artist": "_artist", "feature": "_feature"})


def merge_similar_artists(tracks: DataFrame, least: float = 90.0, at_most: int = 5, in_doubles: bool = False) -> DataFrame:
    """Artists of few tracks take the commonest spelling of a similar one with more, from the state before the pass.
    For ``in_doubles`` see :func:`recordloom.operators.fuzzy.similar_pairs`."""
    rows = hold(groups.keyed(_texts(tracks)), "keyed")
    counted = rows.where("letter <> ''").groupBy("letter", "artist_key").agg(F.count(F.lit(1)).alias("n"))
    targets = fuzzy.merge_targets(counted, ["letter"], "artist_key", least, at_most, in_doubles)
    spelled = groups.majority(rows, ["artist_key"], "artist").select(F.col("artist_key").alias("target"), F.col("artist").alias("_spelled"))
    side = targets.join(spelled, "target", "left").select(F.col("artist_key").alias("_k"), F.coalesce("_spelled", "target").alias("_new"))
    return rows.join(side, F.col("artist_key") == F.col("_k"), "left").withColumn("artist", F.coalesce("_new", "artist")).drop("_k", "_new", "artist_key", "song_key", "letter")


def merge_similar_songs(tracks: DataFrame, least: float = 85.0) -> DataFrame:
    """Titles of one artist that are similar take the commonest spelling of the one with more tracks."""
    rows = hold(groups.keyed(_texts(tracks)), "keyed")
    counted = rows.where("letter <> ''").groupBy("artist_key", "song_key").agg(F.count(F.lit(1)).alias("n"))
    targets = fuzzy.merge_targets(counted, ["artist_key"], "song_key", least)
    spelled = groups.majority(rows, ["artist_key", "song_key"], "song").select("artist_key", F.col("song_key").alias("target"), F.col("song").alias("_spelled"))
    side = targets.join(spelled, ["artist_key", "target"], "left").select(F.col("artist_key").alias("_a"), F.col("song_key").alias("_k"), F.coalesce("_spelled", "target").alias("_new"))
    met = rows.join(side, (F.col("artist_key") == F.col("_a")) & (F.col("song_key") == F.col("_k")), "left")
    return met.withColumn("song", F.coalesce("_new", "song")).drop("_a", "_k", "_new", "artist_key", "song_key", "letter")


def all_clean(tracks: DataFrame, aliases: DataFrame | None = None, in_doubles: bool = False) -> DataFrame:
    """Every cleanup pass in order; each sees what the one before it changed.

    Passes that group read their input several times, so each gets a written table.  Tracks are dealt out first: the
    cleanups of a row take much longer than reading it, and a small file of many rows is read by a task or two.
    """
    out = hold(fill_from_tags(fix_trailing_articles(clean(tracks.repartition("path")))), "clean")
    out = hold(uncomma_artists(out, aliases), "uncomma")
    out = hold(ungroup_artists(out), "ungroup")
    out = hold(merge_similar_artists(out, in_doubles=in_doubles), "merge")
    return merge_similar_songs(out)


def unswap(tracks: DataFrame, more_than: int = 3) -> DataFrame:
    """Artist and song changed places on representative tracks of small artists whose song is a known artist, in
    folders that have more than three of them."""
    rows = _texts(tracks)
    known = groups.known_artists(rows, 3)
    reps = groups.single_artist_reps(rows, 3)
    reps = groups.flag_known(groups.flag_known(reps, X.clean_artist("song"), known, "_song_known"), F.col("artist_key"), known, "_artist_known")
    reps = reps.where("_song_known and not _artist_known").select("path", "artist", "song", X.folder("path").alias("_folder"))
    folders = reps.groupBy("_folder").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    changes = reps.join(folders, "_folder", "left_semi")
    return _update(rows, changes, {"artist": "song", "song": "artist"})


def refresh_names(tracks: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Names read again from stems of two parts, with the known artist first; Unknown tracks of other stems are parsed
    anew.  With ``listing`` (path), only tracks that are in it."""
    rows = _texts(tracks)
    known = groups.known_artists(rows, 5)
    parts = F.split(F.replace(X.stem("path"), F.lit("_"), F.lit(" ")), " - ")
    out = rows.withColumns({"_n": F.size(parts), "_1": F.get(parts, F.lit(0)), "_2": F.get(parts, F.lit(1)), "_again": S.parse_artist_song(X.stem("path"))})
    for side in ("1", "2"):
        key = F.when(F.col("_n") == 2, X.clean_artist(f"_{side}"))
        prefix = F.split_part(key, F.lit("&"), F.lit(1))
        out = groups.flag_known(groups.flag_known(out, key, known, f"_whole{side}"), F.coalesce(X.uncomma_artist(prefix), prefix), known, f"_prefix{side}")
    if listing is not None:
        side = listing.select(F.col("path").alias("_path")).distinct()
        out = out.join(side, F.col("path") == F.col("_path"), "left").withColumn("_listed", F.col("_path").isNotNull())
    else:
        out = out.withColumn("_listed", F.lit(True))
    first, second = F.col("_whole1") | F.col("_prefix1"), F.col("_whole2") | F.col("_prefix2")
    two = F.col("_listed") & (F.col("_n") == 2)
    ahead, behind = two & first & ~second, two & second & ~first
    anew = F.col("_listed") & ~F.col("_n").isin(2, 3) & (F.col("_again.artist") != "") & (F.col("_again.song") != "") & X.is_unknown("artist")
    artist = F.when(ahead, F.col("_1")).when(behind, F.col("_2")).when(anew, F.col("_again.artist")).otherwise(F.col("artist"))
    song = F.when(ahead, F.col("_2")).when(behind, F.col("_1")).when(anew, F.col("_again.song")).otherwise(F.col("song"))
    return out.withColumns({"artist": artist, "song": song}).select(*rows.columns)


def fix_unknown(tracks: DataFrame) -> DataFrame:
    """Unknown artists from titles that hold them before a delimiter, where the name has more than five tracks."""
    rows = _texts(tracks)
    known = groups.known_artists(rows, 5)
    song = F.replace(F.col("song"), F.lit("_"), F.lit(" "))
    dashed, tight = F.split(song, " - "), F.transform(F.split(song, "-"), X.strip)
    spaced, listed = F.split(song, "  "), F.transform(F.split(song, ","), X.strip)
    at = lambda parts, k: F.get(parts, k if isinstance(k, Column) else F.lit(k))
    n = F.size
    cases = [
        (song.contains(" - "), n(dashed).isin(2, 3, 4), at(dashed, n(dashed) - 2), at(dashed, n(dashed) - 1)),
        (song.contains("-"), n(tight).isin(2, 3), at(tight, n(tight) - 2), at(tight, n(tight) - 1)),
        (song.contains("  "), n(spaced) == 2, at(spaced, 0), at(spaced, 1)),
        (song.contains(","), n(listed) == 2, at(listed, 0), at(listed, 1)),
    ]
    pair = None
    for has, fits, artist, title in cases:
        value = F.when(fits, F.struct(artist.alias("a"), title.alias("s")))
        pair = F.when(has, value) if pair is None else pair.when(has, value)
    both_ways = ~song.contains("-") & song.contains("  ")
    out = rows.withColumns({"_pair": F.when(X.is_unknown("artist"), pair), "_both": both_ways})
    out = groups.flag_known(out, X.clean_artist("_pair.a"), known, "_ahead")
    out = groups.flag_known(out, F.when(F.col("_both"), X.clean_artist("_pair.s")), known, "_behind")
    new_artist = F.when(F.col("_ahead"), F.col("_pair.a")).when(F.col("_behind"), F.col("_pair.s")).otherwise(F.col("artist"))
    new_song = F.when(F.col("_ahead"), F.col("_pair.s")).when(F.col("_behind"), F.col("_pair.a")).otherwise(F.col("song"))
    return out.withColumns({"artist": new_artist, "song": new_song}).select(*rows.columns)
