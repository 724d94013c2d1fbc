"""Text normalisation as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` and ``str.split`` of the exchange format's writers see it.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"

# Word lists and patterns that decide which names are equal.
JOINERS = (" with ", " and ", " + ", " feat. ", " f. ", " ft. ", " ft ", " featuring ", " feat ")
SONG_MARKS = ("(duet)", "(solo)", "(gospel)", "(instrumental version)")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
BAND_WORDS = (" and ", " ft ", " ft. ", " feat ", " feat. ", " featuring ", " with ", " the ")
KARAOKE_BRACKET = r"(?i)\s*\[[^\]]*karaoke[^\]]*\]"
TECHNICAL_PAREN = r"(?i)\s*\((?:wo?bgv|w/?bgv|no bgv|bgv|wvocals?|vr|multiplex|mplx|no backing vocals?|instr\.?|instrumental(?: version)?)\)"
TAG_SUFFIX = r"(?i)\s*\((?:w[\s-]?o?b?gv|bgv|w[\s-]?vocals?|wvocals?|duet|solo|instrumental|music only)\)\s*"
CATALOG_PREFIX = r"^[A-Za-z]{2,}\p{Nd}+[-\p{Nd}]*\s*-\s*"
ARTIST_NOISE = r"(?i)\(.*?\)|\bw[\s-]?o?b?gv\b|\bwvocals?\b|\bmultiplex\b|\bvr\b"
QUERY_NOISE = r"(?i)\(.*?\)|\[.*?\]|\bw[\s-]?o?b?gv\b|\bwvocals?\b|\bmultiplex\b|\bmplx\b|\bvr\b|\bkaraoke\b"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(x: Column, of) -> Column:
    """``of(x)`` with x worked out once, for long expressions that use it several times."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def sub(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, pattern, by)


def strip(x: Column | str) -> Column:
    return sub(col(x), rf"^{SPACE}+|{SPACE}+\z")


def words(x: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(x, SPACE + "+"), lambda w: w != "")


def swap_out(x: Column, olds, new: str = "") -> Column:
    return reduce(lambda c, old: F.replace(c, F.lit(old), F.lit(new)), olds, x)


def count_of(x: Column, mark: str) -> Column:
    """How often a one-character mark is in the text."""
    return F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))


def is_unknown(artist: Column | str) -> Column:
    return F.lower(col(artist)).isin("unknown", "")


def clean_artist(artist: Column | str) -> Column:
    """The key under which spellings of one artist meet."""
    x = F.replace(F.lower(col(artist)), F.lit("_"), F.lit(" "))
    x = swap_out(x, JOINERS, " & ")
    x = F.replace(F.replace(F.replace(x, F.lit("'"), F.lit("")), F.lit("."), F.lit(" ")), F.lit("  "), F.lit(" "))
    return strip(sub(sub(x, "^the "), r", the\z"))


def clean_song(song: Column | str) -> Column:
    """The key under which spellings of one title meet."""
    x = sub(F.lower(col(song)), r"\[[^\]]*karaoke[^\]]*\]", " ")
    x = F.replace(swap_out(x, ("-", ".")), F.lit("&"), F.lit("and"))
    x = swap_out(F.replace(x, F.lit("in' "), F.lit("ing ")), SONG_MARKS)
    for pattern in ("^a ", "^the ", r", the\z", r" the\z", r", a\z", ","):
        x = sub(x, pattern)
    x = sub(x, rf"{SPACE}*\([^)]*\){SPACE}*", " ")
    return strip(sub(x, rf"{SPACE}{{2,}}", " "))


def letter(key: Column | str) -> Column:
    """First letter of a key; # for other characters, empty for an empty key."""
    first = F.substring(col(key), 1, 1)
    return F.when(first.rlike("^[^a-z]"), "#").otherwise(first)


def safe_folder(name: Column | str) -> Column:
    x = strip(sub(col(name), r"""[\\/:*?"<>|]""", "-"))
    return F.when(x == "", "_").otherwise(x)


def token_set(x: Column) -> Column:
    """Sorted distinct words of lower-case ASCII letters and digits."""
    return F.array_sort(F.array_distinct(words(sub(F.lower(x), "[^a-z0-9 ]", " "))))


def strip_artist_echo(artist: Column | str, song: Column | str) -> Column:
    """The title without a dash-separated part that has exactly the artist's words; null where there is none."""
    artist, song = col(artist), col(song)
    own = token_set(F.coalesce(artist, F.lit("")))
    dashes = F.filter(F.sequence(F.lit(1), F.length(song)), lambda i: F.substring(song, i, F.lit(1)) == "-")
    cuts = F.transform(dashes, lambda i: F.struct(strip(F.substring(song, F.lit(1), i - 1)).alias("l"), strip(F.substring(song, i + 1, F.length(song))).alias("r")))
    cuts = F.filter(cuts, lambda c: (c["l"] != "") & (c["r"] != ""))
    lead = F.filter(cuts, lambda c: token_set(c["l"]) == own)
    tail = F.filter(cuts, lambda c: token_set(c["r"]) == own)
    found = F.when(F.size(lead) > 0, F.get(lead, F.lit(0))["r"]).when(F.size(tail) > 0, F.get(tail, F.size(tail) - 1)["l"])
    return F.when((F.size(own) > 0) & (song != ""), found)


def uncomma_artist(artist: Column | str) -> Column:
    """'Last, First' of a person as 'First Last'; null where it's better left alone."""
    halves = lambda a: F.struct(a.alias("a"), strip(F.split_part(a, F.lit(","), F.lit(1))).alias("last"), strip(F.split_part(a, F.lit(","), F.lit(2))).alias("first"))

    def part_suffix(h: Column) -> Column:
        head = words(h["first"])
        end = F.try_element_at(head, F.lit(-1))
        moved = (F.size(head) > 1) & F.lower(sub(end, r"\.+\z")).isin(*NAME_SUFFIXES)
        first = F.when(moved, F.array_join(F.slice(head, F.lit(1), F.greatest(F.size(head) - 1, F.lit(0))), " ")).otherwise(h["first"])
        return F.struct(h["a"].alias("a"), h["last"].alias("last"), first.alias("first"), F.when(moved, F.concat(F.lit(" "), end)).otherwise("").alias("suffix"))

    def turn(p: Column) -> Column:
        joined = F.concat(F.lit(" "), F.lower(p["last"]), F.lit(" "), F.lower(p["first"]), F.lit(" "))
        band = F.exists(F.array(*[F.lit(w) for w in ("&", "+", *BAND_WORDS)]), lambda w: F.contains(joined, w))
        fits = (p["last"] != "") & (p["first"] != "") & ~band & (F.size(words(p["first"])) <= 3) & (F.size(words(p["last"])) <= 3)
        return F.when(fits, F.concat(p["first"], F.lit(" "), p["last"], p["suffix"]))

    whole = col(artist)
    return F.when(count_of(whole, ",") == 1, bind(bind(halves(whole), part_suffix), turn))


def auto_clean_artist(artist: Column | str) -> Column:
    """struct(artist, feature): the primary artist of a credit, uncommaed, and the rest or null."""
    raw = sub(col(artist), rf"(?i){SPACE}+(?:with|and|feat\.?|f\.|ft\.?|featuring){SPACE}+", " & ")
    parts = F.split(raw, "&", 2)
    primary = strip(parts[0])
    return F.struct(F.coalesce(uncomma_artist(primary), primary).alias("artist"), strip(F.get(parts, F.lit(1))).alias("feature"))


def artist_tokens(artist: Column | str) -> Column:
    """Token set of a credit without catalog ids, noise and joiners; empty for null."""
    x = sub(sub(F.coalesce(col(artist), F.lit("")), CATALOG_PREFIX), ARTIST_NOISE, " ")
    return token_set(F.replace(sub(x, r"(?i)\b(feat|ft|featuring|and)\b", " "), F.lit("&"), F.lit(" ")))


def query_form(x: Column | str, uncomma: bool = False) -> Column:
    """A field as it is put into a search; with ``uncomma`` the name before the first joiner is turned around."""
    y = sub(sub(F.coalesce(col(x), F.lit("")), CATALOG_PREFIX), QUERY_NOISE, " ")
    if uncomma:
        split = r"(?is)^(.*?)((?:\s*(?:&|\b(?:and|feat|ft|featuring)\b\.?)\s*.*)?)\z"
        head, rest = F.regexp_extract(y, split, 1), F.regexp_extract(y, split, 2)
        left, right = strip(F.split_part(head, F.lit(","), F.lit(1))), strip(F.split_part(head, F.lit(","), F.lit(2)))
        turned = F.when((count_of(head, ",") == 1) & (left != "") & (right != ""), F.concat_ws(" ", right, left)).otherwise(head)
        y = F.concat(turned, rest)
    return strip(sub(y, SPACE + "+", " "))


def escape_phrase(x: Column | str) -> Column:
    """A text that may stand in a quoted phrase of a search."""
    return strip(F.translate(col(x), '\\"', "  "))


def credit_name(credit: Column | str) -> Column:
    """Display name of an array of struct(name, artist_name, joinphrase)."""
    parts = F.transform(col(credit), lambda c: F.concat(F.coalesce(F.nullif(c["name"], F.lit("")), c["artist_name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit(""))))
    return strip(F.coalesce(F.array_join(parts, ""), F.lit("")))


def equality_key(x: Column | str) -> Column:
    return sub(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]")


def norm_eq(a: Column | str, b: Column | str) -> Column:
    """Equal but for case, spaces and punctuation."""
    return equality_key(a) == equality_key(b)


def book_display(x: Column | str) -> Column:
    y = sub(sub(F.coalesce(col(x), F.lit("")), KARAOKE_BRACKET), TECHNICAL_PAREN)
    return strip(sub(y, rf"{SPACE}{{2,}}", " "))


def fix_trailing_article(x: Column | str) -> Column:
    """'Beatles, The' as 'The Beatles', for one name without comma or dash."""
    x = col(x)
    pattern = rf"(?i)^([^,]*[^\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]),{SPACE}*(the|a|an){SPACE}*\z"
    y = strip(x)
    name, article = F.regexp_extract(y, pattern, 1), F.regexp_extract(y, pattern, 2)
    return F.when((article != "") & ~name.contains("-"), F.concat(F.initcap(article), F.lit(" "), name)).otherwise(x)


def number(x: Column | str) -> Column:
    """The whole part of a number in a text, 0 where it is none."""
    return F.coalesce(col(x).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def whole(x: Column | str) -> Column:
    """A whole number in a text, 0 where it is none; '12.5' is none."""
    return F.coalesce(F.when(col(x).rlike(r"^\s*[+-]?[0-9]+\s*\z"), F.trim(col(x)).try_cast("bigint")), F.lit(0).cast("bigint"))


def year(x: Column | str) -> Column:
    """First year from 1900 to 2099 in a text; null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(19|20)\p{Nd}\p{Nd}", 0), F.lit("")).try_cast("int")


def stem(path: Column | str) -> Column:
    """File name without folders and its last extension."""
    return sub(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*\z")


def folder(path: Column | str) -> Column:
    return sub(col(path), r"/[^/]*\z")


def with_suffix(path: Column | str, ext: Column) -> Column:
    """A path with its last extension replaced."""
    return F.concat(sub(col(path), r"(?<=[^/])\.[^./]*\z"), F.lit("."), ext)


def playable_ext(file_types: Column | str) -> Column:
    types = col(file_types)
    return F.when(F.array_contains(types, "zip"), "zip").when(F.array_contains(types, "mp3"), "mp3")


def hours(seconds: Column | str) -> Column:
    """Seconds as hours and days, for reports."""
    return F.concat(F.format_number(col(seconds) / 3600, 0), F.lit("h ("), F.format_number(col(seconds) / 86400, 1), F.lit(" days)"))


def book_details(length, bitrate, year_text, album) -> Column:
    """'Length: m:ss @ N kbps · year · album' with unknown pieces left out."""
    seconds = col(length).try_cast("double").try_cast("bigint")
    kbps = F.when(col(bitrate).rlike(r"^\s*[+-]?[0-9]+\s*\z"), F.floor(F.trim(col(bitrate)).try_cast("bigint") / 1000))
    time = F.when(seconds.isNotNull(), F.concat(F.lit("Length: "), F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))
    head = F.concat_ws(" @ ", time, F.when(kbps.isNotNull(), F.concat(kbps.cast("string"), F.lit(" kbps"))))
    return F.concat_ws(" · ", F.nullif(head, F.lit("")), year(year_text).cast("string"), F.nullif(F.substring(col(album), 1, 48), F.lit("")))


def metadata_line(length, bitrate, mp3_size, cdg_size, mp3_hash, cdg_hash) -> Column:
    """One line about a file; numbers that don't parse raise, as they do in the exchange format."""
    thousand = lambda c: F.floor(F.coalesce(col(c), F.lit("0")).cast("bigint") / 1000).cast("string")
    text = lambda c: F.coalesce(col(c), F.lit(""))
    return F.concat(
        F.lit("sec "), text(length), F.lit(", bitrate "), thousand(bitrate), F.lit(" m.sz "), thousand(mp3_size), F.lit("k c.sz "),
        thousand(cdg_size), F.lit("k m# "), F.substring(text(mp3_hash), 1, 6), F.lit(" c# "), F.substring(text(cdg_hash), 1, 6),
    )
