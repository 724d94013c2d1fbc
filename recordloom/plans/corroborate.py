"""Passes that hold tracks against outside records.

What a web service answered comes in as a table of candidates, one row a record: (shape, query_artist, query_title,
rank, artist, title).  ``shape`` is the kind of search; queries are lower-case and stripped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stems as S
from ..functions import text as X
from ..functions.keys import ONLINE_BELOW, combine_key_signals, normalize_key, profile_to_key, to_camelot
from ..functions.similarity import match_form, ratio, similarity
from ..operators import groups
from ..schema import meta, with_meta
from .review import review_queue

# Similarities from which a match is strong, or worth a look.
STRONG, WEAK = 88, 70
# How many records each kind of search asks for.
ANSWERS = {"direct": 5, "title": 20, "release": 10, "restitch": 25, "key": 10}


def _phrase(field: str, value: Column) -> Column:
    return F.concat(F.lit(f'{field}:"'), X.escape_phrase(value), F.lit('"'))


def _both(*parts: Column) -> Column:
    return F.concat_ws(" AND ", *parts)


def queries_for(tracks: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(shape, query_artist, query_title, text, answers) of the searches that a collector has to make, each once.

    ``text`` is what to search for, of several spellings the smallest, and ``answers`` how many records to ask for.
    With the review ``state`` there are also those for titles in pieces.  Shape ``key`` is for :func:`online_keys`.
    """
    artist, song = X.strip("artist"), X.strip("song")
    a, s = F.lower(artist), F.lower(song)
    by, title = _phrase("artist", X.query_form(artist, uncomma=True)), _phrase("recording", X.query_form(song))
    shapes = {
        "direct": (a, s, _both(by, title)),
        "title": (F.lit(""), s, title),
        "release": (a, s, _both(title, _phrase("release", X.query_form(artist)))),
        "key": (a, s, F.when((X.escape_phrase(artist) != "") & (X.escape_phrase(song) != ""), _both(_phrase("artist", artist), _phrase("recording", song)))),
    }
    turned = _both(_phrase("artist", X.query_form(song, uncomma=True)), _phrase("recording", X.query_form(artist)))
    asked = [(shape, *of) for shape, of in shapes.items()] + [("direct", s, a, turned)]
    structs = F.array(*[F.struct(F.lit(shape).alias("shape"), qa.alias("query_artist"), qt.alias("query_title"), text.alias("text")) for shape, qa, qt, text in asked])
    # What two tracks share is asked once: distinct pairs first, as texts take several patterns each.
    out = tracks.where((a != "") & (s != "")).select("artist", "song").distinct().select(F.explode(structs).alias("q")).select("q.*")
    if state is not None:
        words = restitch_questions(tracks, state).where(F.size("words") > 0)
        any_of = F.concat(F.lit("recording:("), F.array_join(F.transform("words", X.escape_phrase), " AND "), F.lit(")"))
        out = out.unionByName(words.select(
            F.lit("restitch").alias("shape"), F.lower("artist").alias("query_artist"), F.lower(F.array_join("words", " ")).alias("query_title"),
            _both(_phrase("artist", X.query_form("artist", uncomma=True)), any_of).alias("text"),
        ))
    answers = F.create_map(*[F.lit(x) for pair in ANSWERS.items() for x in pair])
    found = out.where("text is not null").groupBy("shape", "query_artist", "query_title").agg(F.min("text").alias("text"))
    return found.withColumn("answers", answers[F.col("shape")])


QUESTION = ("shape", "query_artist", "query_title")


def _records(candidates: DataFrame) -> DataFrame:
    """``candidates``, each record of a search once with its first rank, and as they are compared in ``_ga``, ``_gt``."""
    once = candidates.groupBy(*QUESTION, "artist", "title").agg(F.min("rank").alias("rank"))
    return once.withColumns({"_ga": match_form("artist"), "_gt": match_form("title")})


def candidate_best(asked: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, artist_sim, title_sim, mb_artist, mb_title): the candidate of each row with the largest sum of both
    similarities, the first of equals.  ``asked`` has keys, shape, query_artist, query_title, our_artist, our_title.

    Rows that ask the same, and records that say the same, are compared once: a search of n rows and m records that all
    repeat a few would make n * m comparisons.
    """
    ours = [*QUESTION, "our_artist", "our_title"]
    once = asked.select(*ours).distinct().withColumns({"_fa": match_form("our_artist"), "_ft": match_form("our_title")})
    scored = once.join(_records(candidates), [*QUESTION]).withColumns({"artist_sim": ratio("_fa", "_ga"), "title_sim": ratio("_ft", "_gt")})
    total = F.col("artist_sim") + F.col("title_sim")
    order = F.struct((-total).alias("t"), "rank", "artist", "title")
    found = F.struct(order.alias("o"), F.struct("artist_sim", "title_sim", F.col("artist").alias("mb_artist"), F.col("title").alias("mb_title")).alias("b"))
    best = scored.where(total > 0).groupBy(*ours).agg(F.min_by(found, order).alias("_b"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ours], "_b")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c.startswith("our_") else F.col(c) == F.col(f"_{c}") for c in ours]
    return asked.join(best, same).groupBy(*keys).agg(F.min_by("_b.b", "_b.o").alias("_b")).select(*keys, "_b.*")


def corroborate(tracks: DataFrame, state: DataFrame, candidates: DataFrame, recheck: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tracks in review against candidates: a direct match, then one the other way round, then by title alone, then a
    suggestion by title and release.  Strong matches settle a track (swapping it if need be); weak ones are noted."""
    rows = with_meta(tracks, "mb_checked", "mb_match", "mb_artist", "mb_title")
    todo = F.col("mb_checked").isNull()
    if recheck:
        todo = todo | F.col("mb_match").isin("none", "flag", "suggest")
    a, s = X.strip("artist"), X.strip("song")
    asked = review_queue(rows, state).where(todo & (a != "") & (s != "")).select(F.lower(a).alias("_a"), F.lower(s).alias("_s"), a.alias("our_artist"), s.alias("our_title"))
    # One question a pair, however many tracks ask it.
    pairs = asked.groupBy("_a", "_s").agg(F.min(F.struct("our_artist", "our_title")).alias("o")).select("_a", "_s", "o.*")
    keys = ["_a", "_s"]

    def best(shape: str, artist: Column, title: Column, ours: tuple[str, str], prefix: str) -> DataFrame:
        q = pairs.select(*keys, F.lit(shape).alias("shape"), artist.alias("query_artist"), title.alias("query_title"), F.col(ours[0]).alias("our_artist"), F.col(ours[1]).alias("our_title"))
        found = candidate_best(q, candidates, keys)
        return found.select(*keys, F.struct("artist_sim", "title_sim", "mb_artist", "mb_title").alias(prefix))

    own = ("our_artist", "our_title")
    direct = best("direct", F.col("_a"), F.col("_s"), own, "d")
    other = best("direct", F.col("_s"), F.col("_a"), own[::-1], "r")
    title = best("title", F.lit(""), F.col("_s"), own, "t")
    release = pairs.select(*keys, F.lit("release").alias("shape"), F.col("_a").alias("query_artist"), F.col("_s").alias("query_title"), match_form("our_title").alias("_ft")).join(_records(candidates), [*QUESTION])
    release = release.where(ratio("_ft", "_gt") >= STRONG).groupBy(*keys).agg(F.min_by(F.struct("artist", "title"), F.struct("rank", "artist", "title")).alias("l"))
    met = pairs
    for side in (direct, other, title, release):
        met = met.join(side, keys, "left")
    strong = lambda c: F.coalesce((F.col(f"{c}.artist_sim") >= STRONG) & (F.col(f"{c}.title_sim") >= STRONG), F.lit(False))
    weak = F.coalesce((F.col("d.artist_sim") >= WEAK) & (F.col("d.title_sim") >= WEAK), F.lit(False))
    suggested = F.coalesce(F.col("l.artist"), F.lit("")) != ""
    kind = F.when(strong("d"), "ok").when(strong("r"), "swap").when(strong("t"), "title").when(weak, "flag").when(suggested, "suggest").otherwise("none")
    result = met.select(
        *keys, kind.alias("_kind"),
        F.when(kind == "flag", F.col("d.mb_artist")).when(kind == "suggest", F.col("l.artist")).alias("_mb_artist"),
        F.when(kind == "flag", F.col("d.mb_title")).when(kind == "suggest", F.col("l.title")).alias("_mb_title"),
    )
    queue = review_queue(rows, state).where(todo).select(F.col("path").alias("_path"), F.lower(a).alias("_a"), F.lower(s).alias("_s"))
    side = queue.join(result, keys).drop(*keys)
    out = rows.join(side, F.col("path") == F.col("_path"), "left")
    hit, swap = F.col("_kind").isNotNull(), F.coalesce(F.col("_kind") == "swap", F.lit(False))
    settled = out.where(F.col("_kind").isin("ok", "swap", "title")).select("path")
    out = out.withColumns({
        "artist": F.when(swap, F.col("song")).otherwise(F.col("artist")), "song": F.when(swap, F.col("artist")).otherwise(F.col("song")),
        "mb_checked": F.when(hit, "1").otherwise(F.col("mb_checked")), "mb_match": F.coalesce("_kind", "mb_match"),
        "mb_artist": F.coalesce("_mb_artist", "mb_artist"), "mb_title": F.coalesce("_mb_title", "mb_title"),
    })
    return out.select(*rows.columns), settled


def rejoin_artists(stems: DataFrame, known: DataFrame) -> DataFrame:
    """(path, artist, rest): of ``stems`` (path, parts), the longest run of two or more leading parts, but not all,
    that is a known artist."""
    n = F.size("parts")
    cuts = F.when(n >= 3, F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    runs = stems.select("path", "parts", F.explode(cuts).alias("k")).withColumn("artist", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " "))
    side = known.select(F.col("artist_key").alias("_k")).distinct()
    found = runs.join(side, X.clean_artist("artist") == F.col("_k"), "left_semi")
    best = found.groupBy("path").agg(F.max_by(F.struct("artist", S.from_(F.col("parts"), F.col("k") + 1).alias("rest")), "k").alias("b"))
    return best.select("path", "b.artist", "b.rest")


def restitch_questions(tracks: DataFrame, state: DataFrame, recheck: bool = False) -> DataFrame:
    """(path, artist, fragments, words): tracks whose stem is cut into parts, their artist and title fragments."""
    rows = with_meta(tracks, "restitch")
    done = state.where("status = 'ok'").select(F.col("path").alias("_done"))
    todo = rows.join(done, F.col("path") == F.col("_done"), "left_anti")
    todo = todo if recheck else todo.where(F.col("restitch").isNull())
    stems = todo.select("path", F.col("artist").alias("own"), S.split_stem(X.stem("path")).alias("parts")).where(F.size("parts") >= 3)
    known = groups.known_artists(tracks, 1)
    joined = rejoin_artists(stems, known).select("path", F.col("artist").alias("_artist"), F.col("rest").alias("_rest"))
    met = groups.flag_known(stems.join(joined, "path", "left"), X.clean_artist("own"), known, "_own_known")
    own_key = X.clean_artist("own")
    cuts = F.filter(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: X.clean_artist(F.array_join(F.slice("parts", F.lit(1), k), " ")) == own_key)
    cut = F.when(F.col("_own_known"), F.get(cuts, F.lit(0)))
    artist = F.when(F.col("_artist").isNotNull(), F.col("_artist")).when(cut.isNotNull(), F.col("own"))
    fragments = F.when(F.col("_artist").isNotNull(), F.col("_rest")).when(cut.isNotNull(), S.from_(F.col("parts"), cut + 1))
    out = met.select("path", artist.alias("artist"), F.filter(fragments, lambda f: f != "").alias("fragments"))
    return out.where(F.col("artist").isNotNull() & (F.size("fragments") > 0)).withColumn("words", S.reliable_words("fragments"))


def restitch(tracks: DataFrame, state: DataFrame, candidates: DataFrame, recheck: bool = False) -> tuple[DataFrame, DataFrame]:
    """Titles that stems hold in pieces from candidates of the shape ``restitch``, asked for by artist and words."""
    rows = with_meta(tracks, "restitch", "mb_match", "mb_artist", "mb_title")
    asked = restitch_questions(rows, state, recheck).withColumnRenamed("artist", "our_artist")
    keyed = asked.withColumns({"shape": F.lit("restitch"), "query_artist": F.lower("our_artist"), "query_title": F.lower(F.array_join("words", " "))})
    met = keyed.where(F.size("words") > 0).join(candidates, ["shape", "query_artist", "query_title"])
    fits = met.where((similarity("our_artist", "artist") >= STRONG) & S.fragments_match_title("fragments", "title"))
    found = fits.groupBy("path").agg(F.min_by(F.struct("artist", "title"), "rank").alias("b"), F.count_distinct(X.equality_key("title")).alias("titles"))
    length = F.aggregate("fragments", F.lit(0), lambda n, f: n + F.length(X.equality_key(f)))
    side = asked.join(found, "path", "left").select(
        F.col("path").alias("_path"), "b", F.when((F.col("titles") == 1) & (length >= 10), "ok").when(F.col("b").isNotNull(), "suggest").otherwise("none").alias("_kind")
    )
    out = rows.join(side, F.col("path") == F.col("_path"), "left")
    ok, maybe = F.col("_kind") == "ok", F.col("_kind") == "suggest"
    settled = out.where(ok).select("path")
    out = out.withColumns({
        "artist": F.when(ok, F.col("b.artist")).otherwise(F.col("artist")), "song": F.when(ok, F.col("b.title")).otherwise(F.col("song")),
        "restitch": F.coalesce("_kind", "restitch"), "mb_match": F.when(maybe, "suggest").otherwise(F.col("mb_match")),
        "mb_artist": F.when(maybe, F.col("b.artist")).otherwise(F.col("mb_artist")), "mb_title": F.when(maybe, F.col("b.title")).otherwise(F.col("mb_title")),
    })
    return out.select(*rows.columns), settled


def online_keys(found: DataFrame, least: int = 85, at_most: int = 5) -> DataFrame:
    """(query_artist, query_title, key): of ``found`` (query_artist, query_title, rank, score, mbid, key), the first key
    among the first five distinct records of a score of at least 85."""
    by = ["query_artist", "query_title"]
    records = found.where(F.col("score") >= least).groupBy(*by, "mbid").agg(F.min("rank").alias("rank"), F.min_by("key", "rank").alias("key"))
    listed = records.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", normalize_key("key").alias("key")))).alias("l"))  # a search's answers
    return listed.select(*by, F.get(F.filter(F.slice("l", 1, at_most), lambda r: r["key"].isNotNull()), F.lit(0))["key"].alias("key"))


def detect_keys(tracks: DataFrame, profiles: DataFrame, overrides: DataFrame, online: DataFrame, recheck: bool = False) -> DataFrame:
    """Tracks with fused keys.

    ``profiles`` (path, profile) are pitch-class profiles of their audio, ``overrides`` (name, key) are set by hand for
    'artist - song', ``online`` (query_artist, query_title, key) was looked up.  Tracks without audio, and those keyed
    from the same file before, stay as they are unless overridden.
    """
    rows = with_meta(tracks, "tag_key", "mp3_hash", "key", "key_confidence", "key_source", "key_detail", "key_sig", "key_camelot")
    name = F.lower(X.strip(F.concat("artist", F.lit(" - "), "song")))
    side = overrides.groupBy(F.lower(X.strip("name")).alias("_name")).agg(F.max("key").alias("_override"))
    met = rows.join(side, name == F.col("_name"), "left")
    heard = profiles.groupBy(F.col("path").alias("_path")).agg(F.min("profile").alias("_profile"))
    met = met.join(heard, F.col("path") == F.col("_path"), "left").withColumn("_heard", profile_to_key("_profile"))
    net = online.select(F.col("query_artist").alias("_qa"), F.col("query_title").alias("_qt"), F.col("key").alias("_net"))
    met = met.join(net, (F.lower(X.strip("artist")) == F.col("_qa")) & (F.lower(X.strip("song")) == F.col("_qt")), "left")
    audio = F.array_contains("file_types", "mp3") | F.array_contains("file_types", "zip")
    confidence = F.coalesce(F.nullif(F.col("key_confidence"), F.lit("")).try_cast("double"), F.lit(0.0))
    done = (F.coalesce("mp3_hash", F.lit("")) != "") & F.coalesce(F.col("key_sig") == F.col("mp3_hash"), F.lit(False))
    if recheck:
        origin = F.coalesce("key_source", F.lit(""))
        done = done & ~(origin.isin("none", "online") | ((origin == "auto") & (confidence < 0.5)))
    by_hand = F.col("_name").isNotNull()
    work = audio & (by_hand | ~done)
    weak = F.col("_heard").isNull() | (F.col("_heard.confidence") < ONLINE_BELOW)
    only = lambda c: F.when(~by_hand, c)
    fused = combine_key_signals(F.col("_override"), only(F.col("tag_key")), only(F.col("_heard.key")), F.col("_heard.confidence"), only(F.when(weak, F.col("_net"))))
    met = met.withColumns({"_work": work, "_fused": fused})
    key, w = F.col("_fused.key"), F.col("_work")
    new = {
        "key_sig": F.coalesce("mp3_hash", F.lit("")), "key_source": F.col("_fused.source"), "key_detail": F.col("_fused.detail"), "key": key,
        "key_confidence": F.when(key.isNotNull(), F.format_string("%.3f", F.col("_fused.confidence"))), "key_camelot": to_camelot(key),
    }
    return met.withColumns({k: F.when(w, v).otherwise(F.col(k)) for k, v in new.items()}).select(*rows.columns)


def key_report(tracks: DataFrame) -> DataFrame:
    """(key_source, n, emitted): tracks by where their key comes from, and how many of them publish it."""
    from ..functions.keys import should_emit

    source = F.coalesce(meta(tracks, "key_source"), F.lit("none"))
    confidence = F.coalesce(F.nullif(meta(tracks, "key_confidence"), F.lit("")).try_cast("double"), F.lit(0.0))
    return tracks.groupBy(source.alias("key_source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(should_emit(source, confidence)).alias("emitted"))
