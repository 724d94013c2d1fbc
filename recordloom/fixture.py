"""Track records made from the test tables, and the side tables that the passes take.

The expressions are plain SQL that Spark and DuckDB read alike, so that both sides of a comparison see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = "CASE WHEN p_partkey % 10 >= 7 THEN p_name || ' ' || lower(p_brand) ELSE p_name END"
_WORDS = {
    "ord": "p_partkey", "w1": "split_part(p_name, ' ', 1)", "w2": "split_part(p_name, ' ', 2)", "nm": _NAME,
    "title": "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' ' || p_brand END", "kind": "p_type", "brand": "p_brand", "size": "p_size",
}
_CASES = (
    ("nm", "title"), ("w2 || ', ' || w1", "title"), ("'The ' || nm", "title"), ("nm || ', The'", "title || ', The'"),
    ("nm || ' & ' || w1 || ' Trio'", "title"), ("replace(nm, ' ', '_')", "'The ' || title || ' (Duet)'"),
    ("nm || ' feat. ' || w2", "title || ' [SC Karaoke]'"), ("title", "nm"), ("'Unknown'", "nm || ' - ' || title"),
    ("title", "'SF 193-' || ord"), ("''", "nm || '-' || title"), ("substr(nm, 1, 2) || substr(nm, 4)", "title"),
    ("nm", "w2 || ', ' || w1 || '-' || title"), ("nm || ' (Wbgv)'", "title || ' (WOBGV)'"),
    ("CASE WHEN ord % 32 = 14 THEN '07' ELSE 'SC' || chr(92) || 'SC-' || ord END", "title"),
    ("CASE WHEN ord % 32 = 15 THEN NULL ELSE 'unknown' END", "CASE WHEN ord % 32 = 15 THEN nm || '  ' || title ELSE nm || ',' || title END"),
)
_STEMS = (
    "'T' || ord", "nm || ' - ' || title || ' - SF 193-' || ord", "'SC' || ord || '-02 - ' || nm || ' - ' || title", "title || ' - ' || nm",
    "nm || ' - ' || title", "'DIS61201-13-' || upper(nm) || '-' || title || ' ' || ord",
    "'FLY-03-' || ord || ' - ' || w1 || ' - ' || w2 || ' - Heaven Is A Pla - On ' || kind", "nm || ' - ' || title || ' - SF 003 - 0' || (ord % 10)",
)


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_COLUMNS = {
    "path": f"'lib/' || kind || CASE WHEN ord % 8 IN (3, 4, 7) THEN '/' || ord ELSE '' END || '/' || {_case('ord % 8', _STEMS)} || CASE WHEN ord % 3 = 0 THEN '.zip' ELSE '.cdg' END",
    "file_types": "CASE ord % 3 WHEN 0 THEN array('zip') WHEN 1 THEN array('mp3', 'cdg') ELSE array('cdg') END",
    "artist": _case("ord % 16", [a for a, _ in _CASES]), "song": _case("ord % 16", [s for _, s in _CASES]),
    "mp3_hash": "'h' || ord", "mp3_size": "CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 13 = 0 THEN 'bad' ELSE CAST(size * 1000 AS STRING) END", "cdg_size": "CAST(size * 100 AS STRING)",
    "length_seconds": "CASE WHEN ord % 9 = 0 THEN NULL ELSE CAST(size * 7 + 60 AS STRING) || '.5' END",
    "bitrate_bps": "CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 7 = 1 THEN '0' ELSE CAST(128000 + (ord % 4) * 64000 AS STRING) END",
    "tag_artist": "CASE ord % 5 WHEN 0 THEN nm WHEN 1 THEN NULL WHEN 2 THEN title WHEN 3 THEN 'PS' || (1000 + ord) ELSE nm || ' (Wbgv)' END",
    "tag_year": "CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1950 + ord % 70 AS STRING) || '-01-02' WHEN 2 THEN '' ELSE 'c. ' || CAST(1990 + ord % 30 AS STRING) END",
    "tag_album": "CASE WHEN ord % 3 = 0 THEN 'Album ' || brand ELSE NULL END",
    "tag_key": "CASE ord % 6 WHEN 0 THEN 'Am' WHEN 1 THEN '8B' WHEN 2 THEN 'Gb maj' ELSE NULL END",
    "key": "CASE ord % 4 WHEN 0 THEN 'A minor' WHEN 1 THEN 'C major' WHEN 2 THEN 'F# major' ELSE NULL END",
    "key_confidence": "CASE ord % 5 WHEN 0 THEN '0.900' WHEN 1 THEN '0.400' WHEN 2 THEN 'bad' WHEN 3 THEN '' ELSE '0.500' END",
    "key_source": "CASE ord % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'tag' ELSE 'online' END",
}
_SIDES = {
    "aliases": ("SELECT DISTINCT w2 || ', ' || w1 AS variant, w1 || ' ' || w2 AS canonical FROM words WHERE ord % 2 = 1 UNION ALL SELECT 'same', 'same' UNION ALL SELECT '', 'x'"),
    "state": "SELECT path, CASE WHEN ord % 5 = 0 THEN 'ok' ELSE 'skip' END AS status FROM tracks WHERE ord % 5 = 0 OR ord % 7 = 0",
    "resolutions": "SELECT CASE WHEN ord % 12 = 0 THEN 'gone/' || ord ELSE path END AS path, CASE WHEN ord % 4 = 0 THEN NULL ELSE 'New ' || ord END AS artist, CASE WHEN ord % 8 = 2 THEN NULL ELSE song END AS song, 'why' AS why FROM tracks WHERE ord % 2 = 0 AND ord % 3 = 0",
    "overrides": "SELECT DISTINCT lower(trim(artist || ' - ' || song)) AS name, CASE WHEN ord % 3 = 0 THEN 'A minor' WHEN ord % 3 = 1 THEN 'Gbm' ELSE '8A' END AS key FROM tracks WHERE ord % 160 = 0",
    # All shapes of answers, each for some of the tracks.
    "answers": "SELECT 'direct' AS shape, lower(trim(artist)) AS query_artist, lower(trim(song)) AS query_title, CAST(ord AS INT) AS rank, CASE WHEN ord % 8 = 0 THEN artist ELSE artist || ' Some' END AS artist, song AS title FROM tracks WHERE artist IS NOT NULL AND ord % 4 = 0"
               " UNION ALL SELECT 'title', '', lower(trim(song)), CAST(ord AS INT), CASE WHEN ord % 8 = 1 THEN upper(artist) ELSE 'Other ' || artist END, song FROM tracks WHERE artist IS NOT NULL AND ord % 4 = 1"
               " UNION ALL SELECT 'release', lower(trim(artist)), lower(trim(song)), CAST(ord AS INT), CASE WHEN ord % 7 = 0 THEN '' ELSE 'Real ' || artist END, CASE WHEN ord % 2 = 0 THEN song ELSE 'Not This' END FROM tracks WHERE artist IS NOT NULL AND ord % 5 in (2, 3)"
               " UNION ALL SELECT 'direct', lower(trim(song)), lower(trim(artist)), CAST(ord AS INT), song, artist FROM tracks WHERE artist IS NOT NULL AND ord % 4 = 3",
    "candidates": "SELECT 'direct' AS shape, lower(trim(artist)) AS query_artist, lower(trim(song)) AS query_title, CAST(ord % 3 AS INT) AS rank, CASE WHEN ord % 8 = 1 THEN upper(artist) ELSE 'Other ' || artist END AS artist, CASE WHEN ord % 3 = 0 THEN song || ' Live' ELSE song END AS title FROM tracks WHERE artist IS NOT NULL",
}


def words_sql() -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _WORDS.items()) + " FROM part"


def tracks_sql(spark: bool) -> str:
    """``tracks`` over a view ``words``; arrays are spelt as the engine wants them."""
    text = ", ".join(f"{v} AS {k}" for k, v in _COLUMNS.items())
    return f"SELECT ord, {text if spark else text.replace('array(', 'list_value(')} FROM words"


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the part table."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(*[F.expr(v).alias(k) for k, v in _WORDS.items()])
    return words.select("ord", *[F.expr(v).alias(k) for k, v in _COLUMNS.items()])


def side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A side table; see _SIDES."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(*[F.expr(v).alias(k) for k, v in _WORDS.items()])
    return spark.sql(_SIDES[name].replace("FROM words", "FROM {words}").replace("FROM tracks", "FROM {tracks}"), words=words, tracks=load(spark, sf_dir))


def with_sql(*sides: str) -> str:
    """The head of a DuckDB query that has ``words``, ``tracks`` and the named side tables."""
    parts = [f"words AS ({words_sql()})", f"tracks AS ({tracks_sql(spark=False)})", *[f"{n} AS ({_SIDES[n]})" for n in sides]]
    return "WITH " + ", ".join(parts)
