"""Documents to packed training rows: STAGES in order, each over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, mixing, packing, quality, queries, similar
from recordloom.llm.shared import hold, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labelled documents of the input table.

    Null and empty texts have the score of the bias alone; repeated rows are kept or go alike; an empty table stays so.
    """
    weights = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    kept = quality.with_scores(docs, weights, keep_from=0.5)
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five words.

    Fingerprints find the pairs to compare, sets of shingles decide; see :func:`recordloom.llm.similar.keep_one`.
    """
    return similar.keep_one(docs, size=5, tenths=8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages over a twentieth of their words; null and wordless texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document 0 to 2 times, so that sources come near their targets; see :func:`recordloom.llm.mixing.mix`."""
    return mixing.mix(docs)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids as binary columns; null and empty texts are an end id each."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.tiktoken"), queries.pattern())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("packed token ids", pack_rows),
]

#: The stages train, fingerprint and sample, which SQL can't express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = hold(docs, name.replace(" ", "-"))
    return docs
