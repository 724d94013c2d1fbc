"""Artist and song from file-name stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bind, col, strip, sub, words

# Shapes of catalog ids.
STEM_CATALOG = r"^[A-Za-z]{1,6}-?\p{Nd}[\p{L}\p{N}_-]*\z"
CATALOG_SEGMENT = r"^([A-Za-z]{1,6})[- ]?\p{Nd}[\p{Nd}\- ]*\z"
COMPACT_CATALOG = r"^[A-Za-z]{1,6}\p{Nd}{1,6}-\p{Nd}{1,3}-(.+)"


def is_catalog_segment(seg: Column | str, relaxed: bool = False) -> Column:
    """Whether a segment is a disc catalog id; ``relaxed`` takes shapes that only their place tells from titles."""
    t = strip(F.coalesce(col(seg), F.lit("")))
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    shape = (F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 4) & t.rlike(CATALOG_SEGMENT)
    sure = t.contains("-") | (digits >= 5)
    if relaxed:
        sure = sure | ((digits >= 3) & (F.length(F.regexp_extract(t, CATALOG_SEGMENT, 1)) <= 4))
    return shape & sure


def segments(stem: Column | str) -> Column:
    """Stripped parts between ' - ', without empty ones."""
    return F.filter(F.transform(F.split(col(stem), " - "), strip), lambda p: p != "")


def drop_last(parts: Column, n: int) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0)))


def from_(parts: Column, start: int | Column) -> Column:
    """Parts from a place on, counted from 1."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(parts, start, F.greatest(F.size(parts) - start + 1, F.lit(0)))


def trim_trailing_catalog(parts: Column) -> Column:
    def trim(p: Column) -> Column:
        last, before = F.try_element_at(p, F.lit(-1)), F.try_element_at(p, F.lit(-2))
        pair = (F.size(p) >= 3) & last.rlike(r"^\p{Nd}{1,3}\z") & is_catalog_segment(before, True)
        single = (F.size(p) >= 2) & is_catalog_segment(last)
        return F.when(pair, drop_last(p, 2)).when(single, drop_last(p, 1)).otherwise(p)

    return bind(parts, trim)


def parse_artist_song(stem: Column | str) -> Column:
    """struct(artist, song); the artist is empty where none can be told."""
    pair = lambda a, s: F.struct(a.alias("artist"), s.alias("song"))
    none = F.lit("")

    def read(x: Column) -> Column:
        stem, parts, trimmed, rest, bare = (x[n] for n in ("stem", "parts", "trimmed", "rest", "bare"))
        dashed = F.contains(stem, F.lit(" - "))
        tailed = dashed & (F.size(parts) > 0) & ~is_catalog_segment(F.get(parts, F.lit(0))) & (F.size(trimmed) != F.size(parts)) & (F.size(trimmed) > 0)
        compact = stem.rlike(COMPACT_CATALOG)
        return (
            F.when(tailed & (F.size(trimmed) == 1), pair(none, F.get(trimmed, F.lit(0))))
            .when(tailed, pair(F.get(trimmed, F.lit(0)), F.array_join(from_(trimmed, 2), " - ")))
            .when(dashed & (F.size(parts) > 2), pair(F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
            .when(dashed & (F.size(parts) == 2), pair(none, F.get(parts, F.lit(1))))
            .when(compact & F.contains(rest, F.lit("-")), pair(strip(F.substring_index(rest, "-", 1)), strip(sub(rest, r"(?s)^[^-]*-"))))
            .when(compact, pair(none, rest))
            .otherwise(pair(none, F.when(bare == "", "Unknown").otherwise(bare)))
        )

    def cut(x: Column) -> Column:
        rest = strip(F.regexp_extract(x["stem"], COMPACT_CATALOG, 1))
        return F.struct(x["stem"].alias("stem"), x["parts"].alias("parts"), trim_trailing_catalog(x["parts"]).alias("trimmed"), rest.alias("rest"), strip(x["stem"]).alias("bare"))

    return bind(bind(F.struct(col(stem).alias("stem"), segments(stem).alias("parts")), cut), read)


def split_stem(stem: Column | str) -> Column:
    """Segments of a stem without its catalog ids."""
    def lead(p: Column) -> Column:
        first = F.replace(F.get(p, F.lit(0)), F.lit(" "), F.lit(""))
        return F.when(F.coalesce(first.rlike(STEM_CATALOG), F.lit(False)), from_(p, 2)).otherwise(p)

    return trim_trailing_catalog(bind(segments(stem), lead))


def fragment_form(x: Column) -> Column:
    return strip(sub(sub(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]", " "), SPACE + "+", " "))


def fragments_match_title(fragments: Column | str, title: Column | str) -> Column:
    """Whether the fragments are in the title in order, the first at its start."""
    def fits(x: Column) -> Column:
        frags, t = x["frags"], x["title"]
        first = F.get(frags, F.lit(0))

        def after(pos: Column, f: Column) -> Column:
            at = F.call_function("locate", f, t, pos + 1)
            return F.when((pos < 0) | (at == 0), F.lit(-1)).otherwise(at - 1 + F.length(f))

        end = F.aggregate(from_(frags, 2), F.length(first), after)
        return F.coalesce((F.size(frags) > 0) & (t != "") & F.startswith(t, first) & (end >= 0), F.lit(False))

    frags = F.filter(F.transform(col(fragments), fragment_form), lambda f: f != "")
    return bind(F.struct(frags.alias("frags"), fragment_form(col(title)).alias("title")), fits)


def reliable_words(fragments: Column | str) -> Column:
    """Up to three longest words that fragments certainly hold whole; ties in order of the words."""
    frags = col(fragments)
    last = F.size(frags) - 1

    def own(frag: Column, i: Column) -> Column:
        w = words(frag)
        n = F.size(w)
        inner = F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0)))
        none = F.array().cast("array<string>")
        head = F.when(n > 1, F.concat(F.slice(w, F.lit(1), F.lit(1)), inner)).otherwise(none)
        tail = F.when(n > 1, F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(none)
        return F.when(i == 0, head).when(i == last, tail).otherwise(inner)

    found = F.transform(F.flatten(F.transform(frags, own)), lambda x: sub(x, "[^A-Za-z0-9']"))
    found = F.array_distinct(F.filter(found, lambda x: F.length(x) >= 3))
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return F.slice(F.transform(ranked, lambda r: r["w"]), 1, 3)
