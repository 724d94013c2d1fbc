import pytest

ODD = [
    (1, "Plain words here, and some more of them to make a line.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, " \t\r\n\x0b\x0c ", "de", "b"),
    (5, "Plain words here, and some more of them to make a line.", "en", "a"),
    (6, "PLAIN WORDS here, and some more\nof them to make a line.", "en", "b"),
    (7, "ÄÖÜ ß é 漢字 🙂 \x00 \x85     <|endoftext|> ###", "de", None),
    (8, "word " * 30_000, "en", "a"),
    (9, "x" * 100_000, "fr", "b"),
    (10, "a\n\nb\r\n\n", None, "ab"),
    (5, "Plain words here, and some more of them to make a line.", "en", "a"),
    (None, "row without an id", "en", "a"),
    (None, None, None, None),
]
#: Columns that operators would like to add, already there.
CLASHES = ("n_words", "n_hit", "items", "spans", "score", "n_lines", "n_tokens", "lang_pred", "row", "node", "component", "size", "copies", "source_size", "shard", "_kept", "_copies", "_place", "id", "key")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("own") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
