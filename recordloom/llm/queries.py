"""The corpus operators over the test tables: ``queries()`` and ``oracle_sql()`` of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language, line_dedup, mixing, packing, quality, simhash, token_counts, warc
from .shared import table


def fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    over = decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), over.alias("contaminated"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, fold(4) != 2)
    found = language.with_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_to_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), pattern())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    scored = quality.with_scores(docs.select("doc_id", "text"), weights)
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_decontaminate, op3_warc, op4_language, op5_mix, op6_pack, op7_token_counts, op8_line_dedup, op9_quality, op10_exact_dedup)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": rf"""
            WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
            wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
                     FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
            docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
                      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
                            FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
            hits AS (SELECT doc_id, n, i, item_id FROM grams JOIN wins USING (n, g)),
            words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
            found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
        "op3_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
            h AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS head FROM p)
            SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
                   CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
            FROM h""",
        "op8_line_dedup": rf"""
            WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
            lines AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line,
                             generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs),
            keyed AS (SELECT r, doc_id, line, i, {_LOWER.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k FROM lines),
            common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
                   sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
            FROM keyed LEFT JOIN common c ON keyed.k = c.k GROUP BY r, doc_id""",
        "op10_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t, length(coalesce(text, '')) AS c FROM documents),
            w AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id,
                         count(*) OVER (PARTITION BY t) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(t) AS text_sha256 FROM w""",
    }
