"""String similarity and accent folding: the two expressions that Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ship
from .text import QUERY_NOISE, SPACE, col, strip, sub, words


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits for a row of the table."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, down to 0: the share of characters that insertions and deletions needn't touch."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = indel_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two texts, 0 to 100; null where one is null."""
    ship(SparkSession.active())
    return _ratio(col(a), col(b))


@F.pandas_udf(T.StringType())
def _ascii(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def to_ascii(x: Column | str) -> Column:
    """Characters decomposed, and what isn't ASCII left out."""
    ship(SparkSession.active())
    return _ascii(col(x))


def fold(x: Column | str) -> Column:
    """Sort and search key without accents and case."""
    return F.lower(to_ascii(x))


def match_form(x: Column | str) -> Column:
    """A credit or title as it is compared: no noise, accents, marks, joiners or outer article, words sorted."""
    y = sub(F.coalesce(col(x), F.lit("")), QUERY_NOISE, " ")
    y = sub(F.lower(F.replace(to_ascii(y), F.lit("'"), F.lit(""))), "[^a-z0-9 ]", " ")
    y = strip(sub(sub(y, r"\b(and|feat|ft|featuring)\b", " "), SPACE + "+", " "))
    y = sub(sub(y, "^the "), r" the\z")
    return F.array_join(F.array_sort(words(y)), " ")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Order- and punctuation-insensitive similarity of two credits or titles, 0 to 100."""
    return ratio(match_form(a), match_form(b))
