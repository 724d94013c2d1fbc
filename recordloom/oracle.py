"""The library's queries in DuckDB's SQL, written from their definitions and apart from the Column functions."""

from __future__ import annotations

from itertools import count

from .fixture import tracks_sql, with_sql
from .functions import keys as K
from .functions import stems as S
from .functions import text as X
from .plans import cleanup

_names = (f"v{i}" for i in count())


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def bind(x: str, of) -> str:
    v = next(_names)
    return f"list_transform([{x}], lambda {v}: {of(v)})[1]"


def each(xs: str, of) -> str:
    v = next(_names)
    return f"list_transform({xs}, lambda {v}: {of(v)})"


def keep(xs: str, of) -> str:
    v = next(_names)
    return f"list_filter({xs}, lambda {v}: {of(v)})"


def swap(x: str, olds, new: str = "") -> str:
    for old in olds:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def strip(x: str) -> str:
    return rx(x, rf"^{X.SPACE}+|{X.SPACE}+\z")


def words(x: str) -> str:
    return keep(f"string_split_regex({x}, {lit(X.SPACE + '+')})", lambda w: f"{w} <> ''")


def has(x: str, part: str) -> str:
    return f"contains({x}, {lit(part)})"


def clean_artist(x: str) -> str:
    y = swap(f"replace(lower({x}), '_', ' ')", X.JOINERS, " & ")
    y = f"replace(replace(replace({y}, '''', ''), '.', ' '), '  ', ' ')"
    return strip(rx(rx(y, "^the "), r", the\z"))


def clean_song(x: str) -> str:
    y = rx(f"lower({x})", r"\[[^\]]*karaoke[^\]]*\]", " ")
    y = swap(f"replace({swap(y, ('-', '.'))}, '&', 'and')", ("in' ",), "ing ")
    y = swap(y, X.SONG_MARKS)
    for p in ("^a ", "^the ", r", the\z", r" the\z", r", a\z", ","):
        y = rx(y, p)
    return strip(rx(rx(y, rf"{X.SPACE}*\([^)]*\){X.SPACE}*", " "), rf"{X.SPACE}{{2,}}", " "))


def letter(key: str) -> str:
    return f"CASE WHEN regexp_matches(substr({key}, 1, 1), '^[^a-z]') THEN '#' ELSE substr({key}, 1, 1) END"


def safe_folder(x: str) -> str:
    return bind(strip(rx(x, r"""[\\/:*?"<>|]""", "-")), lambda v: f"CASE WHEN {v} = '' THEN '_' ELSE {v} END")


def token_set(x: str) -> str:
    return f"list_sort(list_distinct({words(rx(f'lower({x})', '[^a-z0-9 ]', ' '))}))"


def stem(path: str = "path") -> str:
    return bind(f"split_part({path}, '/', -1)", lambda f: f"CASE WHEN regexp_matches({f}, '^.+\\.[^.]*\\z') THEN regexp_replace({f}, '\\.[^.]*\\z', '') ELSE {f} END")


def uncomma(x: str) -> str:
    def halves(a):
        return f"{{'n': length({a}) - length(replace({a}, ',', '')), 'last': {strip(f'split_part({a}, {lit(',')}, 1)')}, 'first': {strip(f'split_part({a}, {lit(',')}, 2)')}}}"

    def ends(h):
        return bind(words(f"{h}.first"), lambda w: f"""{{'n': {h}.n, 'last': {h}.last, 'first': CASE WHEN {moved(w)} THEN array_to_string({w}[1:len({w}) - 1], ' ') ELSE {h}.first END,
            'suffix': CASE WHEN {moved(w)} THEN ' ' || {w}[-1] ELSE '' END}}""")

    def moved(w):
        return f"(len({w}) > 1 AND lower(rtrim({w}[-1], '.')) IN ({', '.join(map(lit, X.NAME_SUFFIXES))}))"

    def turn(p):
        joined = f"(' ' || lower({p}.last) || ' ' || lower({p}.first) || ' ')"
        band = " OR ".join(has(joined, w) for w in ("&", "+", *X.BAND_WORDS))
        return f"CASE WHEN {p}.n = 1 AND {p}.last <> '' AND {p}.first <> '' AND NOT ({band}) AND len({words(p + '.first')}) <= 3 AND len({words(p + '.last')}) <= 3 THEN {p}.first || ' ' || {p}.last || {p}.suffix END"

    return bind(bind(bind(x, halves), ends), turn)


def is_catalog(x: str, relaxed: bool = False) -> str:
    def test(t):
        digits = f"length({rx(t, r'[^\p{Nd}]')})"
        more = f" OR ({digits} >= 3 AND length(regexp_extract({t}, '^[A-Za-z]+')) <= 4)" if relaxed else ""
        return f"(length(replace({t}, ' ', '')) >= 4 AND regexp_matches({t}, {lit(S.CATALOG_SEGMENT)}) AND ({has(t, '-')} OR {digits} >= 5{more}))"

    return bind(strip(f"coalesce({x}, '')"), test)


def segments(x: str) -> str:
    return keep(each(f"string_split({x}, ' - ')", strip), lambda p: f"{p} <> ''")


def trim_trailing(parts: str) -> str:
    def trim(p):
        return rf"""CASE WHEN len({p}) >= 3 AND regexp_matches({p}[-1], '^\p{{Nd}}{{1,3}}\z') AND {is_catalog(p + '[-2]', True)} THEN {p}[1:len({p}) - 2]
            WHEN len({p}) >= 2 AND {is_catalog(p + '[-1]')} THEN {p}[1:len({p}) - 1] ELSE {p} END"""

    return bind(parts, trim)


def parse(x: str) -> str:
    def read(v):
        p, t, r = f"{v}.p", f"{v}.t", f"{v}.r"
        tailed = f"{has(v + '.x', ' - ')} AND len({p}) > 0 AND NOT {is_catalog(p + '[1]')} AND len({t}) <> len({p}) AND len({t}) > 0"
        compact = f"regexp_matches({v}.x, {lit(S.COMPACT_CATALOG)})"
        pair = lambda a, s: f"{{'artist': {a}, 'song': {s}}}"
        return f"""CASE WHEN {tailed} AND len({t}) = 1 THEN {pair("''", t + '[1]')} WHEN {tailed} THEN {pair(t + '[1]', f"array_to_string({t}[2:], ' - ')")}
            WHEN {has(v + '.x', ' - ')} AND len({p}) > 2 THEN {pair(p + '[2]', p + '[3]')} WHEN {has(v + '.x', ' - ')} AND len({p}) = 2 THEN {pair("''", p + '[2]')}
            WHEN {compact} AND {has(r, '-')} THEN {pair(strip(f"split_part({r}, '-', 1)"), strip(f"substr({r}, instr({r}, '-') + 1)"))}
            WHEN {compact} THEN {pair("''", r)} ELSE {pair("''", f"CASE WHEN {strip(v + '.x')} = '' THEN 'Unknown' ELSE {strip(v + '.x')} END")} END"""

    def cut(v):
        return f"{{'x': {v}.x, 'p': {v}.p, 't': {trim_trailing(v + '.p')}, 'r': {strip(f'regexp_extract({v}.x, {lit(S.COMPACT_CATALOG)}, 1)')}}}"

    return bind(bind(bind(x, lambda v: f"{{'x': {v}, 'p': {segments(v)}}}"), cut), read)


def split_stem(x: str) -> str:
    lead = bind(segments(x), lambda p: f"CASE WHEN len({p}) > 0 AND regexp_matches(replace({p}[1], ' ', ''), {lit(S.STEM_CATALOG)}) THEN {p}[2:] ELSE {p} END")
    return trim_trailing(lead)


def fragment_form(x: str) -> str:
    return strip(rx(rx(f"lower(coalesce({x}, ''))", "[^a-z0-9 ]", " "), X.SPACE + "+", " "))


def equality(x: str) -> str:
    return rx(f"lower(coalesce({x}, ''))", "[^a-z0-9]")


def fits(frags: str, title: str) -> str:
    def test(v):
        step = f"list_reduce({v}.f[2:], lambda p, q: CASE WHEN p = '!' OR instr(substr({v}.t, CAST(p AS INT) + 1), q) = 0 THEN '!' ELSE CAST(CAST(p AS INT) + instr(substr({v}.t, CAST(p AS INT) + 1), q) - 1 + length(q) AS VARCHAR) END, CAST(length({v}.f[1]) AS VARCHAR))"
        return f"(len({v}.f) > 0 AND {v}.t <> '' AND starts_with({v}.t, {v}.f[1]) AND {step} <> '!')"

    return f"coalesce({bind(f'{{{lit("f")}: {keep(each(frags, fragment_form), lambda f: f"{f} <> {lit("")}")}, {lit("t")}: {fragment_form(title)}}}', test)}, false)"


def artist_tokens(x: str) -> str:
    y = rx(rx(f"coalesce({x}, '')", X.CATALOG_PREFIX), X.ARTIST_NOISE, " ")
    return token_set(f"replace({rx(y, r'(?i)\b(feat|ft|featuring|and)\b', ' ')}, '&', ' ')")


def plain_form(x: str) -> str:
    return strip(rx(rx(rx(f"coalesce({x}, '')", X.CATALOG_PREFIX), X.QUERY_NOISE, " "), X.SPACE + "+", " "))


def query_form(x: str) -> str:
    y = rx(rx(f"coalesce({x}, '')", X.CATALOG_PREFIX), X.QUERY_NOISE, " ")
    joiner = r"(?is)\s*(?:&|\b(?:and|feat|ft|featuring)\b\.?)\s*.*\z"

    def turn(v):
        head = f"regexp_replace({v}, {lit(joiner)}, '')"
        return bind(head, lambda h: bind(f"{{'l': {strip(f'split_part({h}, {lit(",")}, 1)')}, 'r': {strip(f'split_part({h}, {lit(",")}, 2)')}}}", lambda s: f"CASE WHEN length({h}) - length(replace({h}, ',', '')) = 1 AND {s}.l <> '' AND {s}.r <> '' THEN {s}.r || ' ' || {s}.l ELSE {h} END || substr({v}, length({h}) + 1)"))

    return strip(rx(bind(y, turn), X.SPACE + "+", " "))


def match_form(x: str) -> str:
    y = rx(f"coalesce({x}, '')", X.QUERY_NOISE, " ")
    y = rx(f"lower(replace(strip_accents({y}), '''', ''))", "[^a-z0-9 ]", " ")
    y = strip(rx(rx(y, r"\b(and|feat|ft|featuring)\b", " "), X.SPACE + "+", " "))
    return f"array_to_string(list_sort({words(rx(rx(y, '^the '), r' the\z'))}), ' ')"


def book_display(x: str) -> str:
    return strip(rx(rx(rx(f"coalesce({x}, '')", X.KARAOKE_BRACKET), X.TECHNICAL_PAREN), rf"{X.SPACE}{{2,}}", " "))


def fix_article(x: str) -> str:
    pattern = rf"(?i)^([^,]*[^\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]),{X.SPACE}*(the|a|an){X.SPACE}*\z"
    return bind(f"{{'x': {x}, 'y': {strip(x)}}}", lambda v: f"CASE WHEN regexp_matches({v}.y, {lit(pattern)}) AND NOT {has(f'regexp_extract({v}.y, {lit(pattern)}, 1)', '-')} THEN upper(substr(regexp_extract({v}.y, {lit(pattern)}, 2), 1, 1)) || lower(substr(regexp_extract({v}.y, {lit(pattern)}, 2), 2)) || ' ' || regexp_extract({v}.y, {lit(pattern)}, 1) ELSE {v}.x END")


def strip_echo(artist: str, song: str) -> str:
    def find(v):
        cuts = keep(each(keep(f"range(1, length({v}.s) + 1)", lambda i: f"substr({v}.s, {i}, 1) = '-'"), lambda i: f"{{'l': {strip(f'substr({v}.s, 1, {i} - 1)')}, 'r': {strip(f'substr({v}.s, {i} + 1)')}}}"), lambda c: f"{c}.l <> '' AND {c}.r <> ''")
        return bind(cuts, lambda c: f"CASE WHEN len({v}.a) = 0 THEN NULL ELSE coalesce({keep(c, lambda p: f'{token_set(p + ".l")} = {v}.a')}[1].r, {keep(c, lambda p: f'{token_set(p + ".r")} = {v}.a')}[-1].l) END")

    return bind(f"{{'a': {token_set(f'coalesce({artist}, {lit("")})')}, 's': coalesce({song}, '')}}", find)


def whole(x: str) -> str:
    return rf"coalesce(CASE WHEN regexp_matches({x}, '^\s*[+-]?[0-9]+\s*\z') THEN TRY_CAST(trim({x}) AS BIGINT) END, 0)"


def number(x: str) -> str:
    return f"coalesce(CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT), 0)"


def year(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract(coalesce({x}, ''), '(19|20)\p{{Nd}}\p{{Nd}}'), '') AS INT)"


def details(album: str = "tag_album") -> str:
    seconds = "CAST(trunc(TRY_CAST(length_seconds AS DOUBLE)) AS BIGINT)"
    kbps = "CASE WHEN bitrate_bps IS NOT NULL THEN CAST(TRY_CAST(bitrate_bps AS BIGINT) // 1000 AS VARCHAR) || ' kbps' END"
    head = f"concat_ws(' @ ', 'Length: ' || CAST({seconds} // 60 AS VARCHAR) || ':' || lpad(CAST({seconds} % 60 AS VARCHAR), 2, '0'), {kbps})"
    return f"concat_ws(' · ', nullif({head}, ''), CAST({year('tag_year')} AS VARCHAR), nullif(substr({album}, 1, 48), ''))"


def unknown(x: str = "artist") -> str:
    return f"lower(coalesce({x}, '')) IN ('unknown', '')"


def ratio(a: str, b: str) -> str:
    """Indel similarity by the table of the longest common subsequence, a row a step."""
    def table(v):
        rows = each(f"string_split({v}.a, '')", lambda c: each(f"string_split({v}.b, '')", lambda d: f"CAST({c} = {d} AS INT)"))
        cell = "greatest(r[j], CASE WHEN m[j] = 1 THEN coalesce(r[j - 1], 0) + 1 ELSE 0 END)"
        step = f"list_transform(range(1, len(r) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j: {cell})))"
        return f"list_reduce({rows}, lambda r, m: {step}, {each(f'string_split({v}.b, {lit("")})', lambda _: '0')})"

    return bind(f"{{'a': {a}, 'b': {b}}}", lambda v: f"CASE WHEN length({v}.a) + length({v}.b) = 0 THEN 100.0 WHEN {v}.a = '' OR {v}.b = '' THEN 0.0 ELSE 200.0 * {table(v)}[-1] / (length({v}.a) + length({v}.b)) END")


def normalize_key(x: str) -> str:
    names = "[" + ", ".join(map(lit, K.NAMES)) + "]"
    wheel = "CASE " + " ".join(f"WHEN upper(regexp_extract(s, '[ABab]')) = {lit(code[-1])} AND TRY_CAST(regexp_extract(s, '^[0-9]+') AS INT) = {code[:-1]} THEN {lit(name)}" for code, name in K.WHEEL.items()) + " END"
    space = r"[\x09-\x0D\x1C-\x20]*"
    spelled = rf"^([A-Ga-g]){space}([#b♯♭]?){space}(.*)\z"
    part = lambda i: f"regexp_extract(s, {lit(spelled)}, {i})"
    mode = strip(part(3))
    pitch = "CASE upper(" + part(1) + ") " + " ".join(f"WHEN {lit(n)} THEN {p}" for n, p in K.NATURAL.items()) + " END"
    shift = f"CASE WHEN {part(2)} IN ('#', '♯') THEN 1 WHEN {part(2)} IN ('b', '♭') THEN -1 ELSE 0 END"
    scale = f"CASE WHEN {mode} IN ('m', 'min') THEN 'minor' WHEN {mode} IN ('M', 'maj', '') THEN 'major' WHEN starts_with(lower({mode}), 'min') OR lower({mode}) = 'm' THEN 'minor' WHEN starts_with(lower({mode}), 'maj') THEN 'major' END"
    body = f"""CASE WHEN lower(s) IN ({', '.join(map(lit, K.NOT_A_KEY))}) THEN NULL WHEN regexp_matches(s, {lit(r'^\p{Nd}{1,2}' + space + r'[ABab]\z')}) THEN {wheel}
        WHEN regexp_matches(s, {lit(spelled)}) THEN {names}[({pitch} + {shift} + 12) % 12 + 1] || ' ' || {scale} END"""
    return f"list_transform([{strip(f'coalesce({x}, {lit("")})')}], lambda s: {body})[1]"


def camelot(x: str) -> str:
    return bind(normalize_key(x), lambda k: f"CASE {k} " + " ".join(f"WHEN {lit(name)} THEN {lit(code)}" for code, name in K.WHEEL.items()) + " END")


def emit(source: str, confidence: str) -> str:
    return f"coalesce(CASE WHEN {source} IN ('manual', 'tag') THEN true WHEN {source} IN ('auto', 'online') THEN {confidence} >= 0.5 END, false)"


# ------------------------------------------------------------------------- queries

KEYED = f"keyed AS (SELECT *, {clean_artist("coalesce(artist, '')")} AS artist_key, {clean_song("coalesce(song, '')")} AS song_key FROM tracks), lettered AS (SELECT *, {letter('artist_key')} AS letter FROM keyed)"
COUNTS = "counts AS (SELECT artist_key, count(*) AS n FROM keyed GROUP BY artist_key)"
TITLE = "coalesce(artist, '') || ' - ' || coalesce(song, '')"


def known(more_than: int, name: str = "known") -> str:
    return f"{name} AS (SELECT artist_key AS k FROM counts WHERE artist_key <> '' AND n > {more_than})"


def q(body: str, *ctes: str, sides: tuple = ()) -> str:
    return ", ".join([with_sql(*sides), *ctes]) + " " + body


def tidy(c: str) -> str:
    return f"coalesce({c}, '') AS {c}"


BASE = "base AS (SELECT ord, path, coalesce(artist, '') AS artist, coalesce(song, '') AS song, tag_artist FROM tracks)"
MAJORITY = "spelled AS (SELECT artist_key, artist, n FROM (SELECT artist_key, artist, count(*) AS n, row_number() OVER (PARTITION BY artist_key ORDER BY count(*) DESC, min(ord)) AS r FROM keyed WHERE coalesce(artist, '') <> '' GROUP BY artist_key, artist) WHERE r = 1)"


def scalar(column: str, name: str, of) -> str:
    return q(f"SELECT ord, {of(column)} AS {name} FROM tracks")


def clean_steps() -> str:
    """The cleanup pass, a table a step."""
    first = "CASE " + " ".join(f"WHEN {has('artist', d)} THEN {lit(d)}" for d in cleanup.ARTIST_DESCRIPTORS) + " END"
    steps = [f"c0 AS (SELECT ord, path, coalesce(artist, '') AS artist, coalesce(song, '') AS song, {first.replace('artist', "coalesce(artist, '')")} AS style FROM tracks)"]
    steps.append(f"s0 AS (SELECT ord, path, CASE WHEN style IS NOT NULL THEN {strip("replace(artist, style, '')")} ELSE artist END AS artist, song, style FROM c0)")
    for i, d in enumerate(cleanup.SONG_DESCRIPTORS):
        hit = has("song", d)
        steps.append(f"s{i + 1} AS (SELECT ord, path, artist, CASE WHEN {hit} THEN {strip(f'replace(song, {lit(d)}, {lit("")})')} ELSE song END AS song, CASE WHEN {hit} THEN {lit(d)} ELSE style END AS style FROM s{i})")
    last = f"s{len(cleanup.SONG_DESCRIPTORS)}"
    for k, pattern in enumerate((X.KARAOKE_BRACKET, X.TECHNICAL_PAREN)):
        match = lambda c, p=pattern: f"regexp_matches({c}, {lit(p)})"
        fix = lambda c, p=pattern: f"CASE WHEN {match(c)} THEN {strip(rx(rx(c, p), rf'{X.SPACE}{{2,}}', ' '))} ELSE {c} END AS {c}"
        cut = lambda c, p=pattern: strip(f"regexp_extract({c}, {lit(p)})")
        steps.append(f"m{k} AS (SELECT ord, path, {fix('artist')}, {fix('song')}, CASE WHEN {match('song')} THEN {cut('song')} WHEN {match('artist')} THEN {cut('artist')} ELSE style END AS style FROM {last})")
        last = f"m{k}"
    a = strip("artist")
    bogus = rf"(lower({a}) <> 'unknown' AND (regexp_matches({a}, '^\p{{Nd}}{{1,2}}\z') OR contains({a}, chr(92)) OR {a} = ''))"
    numeric = rf"regexp_matches({a}, '^\p{{Nd}}{{1,2}}\z')"
    parts = f"string_split({stem()}, ' - ')"
    steps.append(f"""b AS (SELECT ord, path, CASE WHEN {bogus} THEN 'Unknown' ELSE artist END AS artist, song, style, CASE WHEN {bogus} AND {numeric} THEN {a} END AS track_no,
        CASE WHEN {bogus} AND {numeric} AND len({parts}) >= 3 THEN {strip(parts + '[1]')} WHEN {bogus} AND NOT {numeric} AND contains({a}, chr(92)) THEN {a} END AS catalog_id FROM m1)""")
    steps.append(f"e AS (SELECT ord, path, artist, coalesce(CASE WHEN NOT {unknown()} THEN {strip_echo('artist', 'song')} END, song) AS song, style, track_no, catalog_id FROM b)")
    steps.append(f"p AS (SELECT *, {parse(stem())} AS again, {segments(stem())} AS parts, {is_catalog('song', True)} AS cat, {strip('song')} AS own FROM e)")
    steps.append(f"f AS (SELECT *, cat AND coalesce(own = parts[-1] OR own = parts[-2], false) AND again.song <> '' AND again.song <> song AND NOT {is_catalog('again.song', True)} AS fix FROM p)")
    return ", ".join(steps)


def flags(source: str, columns: dict[str, str], name: str = "known") -> str:
    """Columns that say whether an expression is a known artist."""
    joins = " ".join(f"LEFT JOIN {name} AS j_{flag} ON j_{flag}.k = {expr}" for flag, expr in columns.items())
    return f"SELECT b.*, {', '.join(f'j_{flag}.k IS NOT NULL AS {flag}' for flag in columns)} FROM {source} b {joins}"


def ks_key() -> str:
    templates = ", ".join(f"({k}, {lit(name)}, [{', '.join(map(str, values))}])" for k, (name, values) in enumerate(K.TEMPLATES))
    dot = lambda x, y: f"list_sum(list_transform(range(1, 13), lambda i: ({x}[i] - m{x}) * ({y}[i] - m{y})))"
    return f"""WITH t(k, name, t) AS (VALUES {templates}), v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings),
        c AS (SELECT vec_id, k, name, p, t, list_sum(p) / 12 AS mp, list_sum(t) / 12 AS mt FROM v, t),
        r AS (SELECT vec_id, k, name, {dot('p', 't')} / sqrt({dot('p', 'p')} * {dot('t', 't')}) AS r FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, k) AS n FROM r)
        SELECT vec_id, max(name) FILTER (n = 1) AS key, round(greatest(0.0, least(1.0, (max(r) FILTER (n = 1) - max(r) FILTER (n = 2)) / {K.FULL_MARGIN})), 3) AS confidence,
               round(max(r) FILTER (n = 1), 4) AS correlation, max(name) FILTER (n = 2) AS runner_up FROM o WHERE n <= 2 GROUP BY vec_id"""


RAW_KEYS = ("Am", "A minor", "F#m", "Gbm", "C", "CM", "Cm", "Bb", "8A", "8b", "12B", "13A", "0A", "H", "", "off", "Cb", "B#", "d min", "e MAJOR", "Fmaj7", "G foo", " a♭m ", "D♯", "n/a")


def raw_keys() -> str:
    return "raws AS (SELECT ord, [" + ", ".join(map(lit, RAW_KEYS)) + "][ord % 25 + 1] AS raw FROM tracks)"


#: What is fused from the normalised signals o, t, h and n and the confidence c.
FUSED = {
    "key": "coalesce(o, t, h, n)",
    "confidence": "CAST(CASE WHEN o IS NOT NULL THEN 1.0 WHEN t IS NOT NULL THEN CASE WHEN t = h OR t = n THEN 0.97 ELSE 0.9 END WHEN h IS NOT NULL THEN round(CASE WHEN h = n THEN least(1.0, c + 0.2) ELSE c END, 3) WHEN n IS NOT NULL THEN 0.5 ELSE 0.0 END AS DOUBLE)",
    "source": "CASE WHEN o IS NOT NULL THEN 'manual' WHEN t IS NOT NULL THEN 'tag' WHEN h IS NOT NULL THEN 'auto' WHEN n IS NOT NULL THEN 'online' ELSE 'none' END",
    "detail": """CASE WHEN o IS NOT NULL THEN '' WHEN t IS NOT NULL THEN CASE WHEN t = h OR t = n THEN 'id3 TKEY (corroborated)' ELSE 'id3 TKEY' END
        WHEN h IS NOT NULL THEN CASE WHEN n IS NULL THEN '' WHEN h = n THEN 'offline+online agree' ELSE 'online disagrees (' || n || ')' END
        WHEN n IS NOT NULL THEN 'original master key; unverified vs rip' ELSE '' END""",
}


def fused() -> str:
    pick = lambda n, *xs: "[" + ", ".join("NULL" if x is None else lit(x) if isinstance(x, str) else str(x) for x in xs) + f"][(ord // {n}) % {len(xs)} + 1]"
    signals = f"sig AS (SELECT ord, {normalize_key(pick(1, None, 'Am', None, 'zz'))} AS o, {normalize_key(pick(4, 'C', None, 'Gbm'))} AS t, {normalize_key(pick(12, 'C major', 'A minor', None))} AS h, {pick(36, 0.3, 0.85, 0.9)} AS c, {normalize_key(pick(108, 'C', None, 'F# minor'))} AS n FROM tracks)"
    return q("SELECT ord, " + ", ".join(f"{v} AS {k}" for k, v in FUSED.items()) + " FROM sig", signals)


def pairs(block: str, name: str, least: float) -> str:
    loss = 1 - least / 100
    return f"""names AS (SELECT DISTINCT {block}, {name} AS x FROM lettered WHERE letter <> '' AND {name} <> ''),
        pairs AS (SELECT l.{block}, l.x AS a, r.x AS b FROM names l JOIN names r ON l.{block} = r.{block} AND l.x < r.x AND abs(length(l.x) - length(r.x)) <= {loss} * (length(l.x) + length(r.x))),
        scored AS (SELECT *, {ratio('a', 'b')} AS ratio FROM pairs), similar_ AS (SELECT * FROM scored WHERE ratio >= {least})"""


def targets(block: str, name: str, most: int | None) -> str:
    cap = f"AND own.n <= {most}" if most else ""
    return f"""sizes AS (SELECT {block}, {name} AS x, count(*) AS n FROM lettered WHERE letter <> '' GROUP BY ALL),
        both_ AS (SELECT {block}, a AS x, b AS target, ratio FROM similar_ UNION ALL SELECT {block}, b, a, ratio FROM similar_),
        best AS (SELECT {block}, x, target FROM (SELECT both_.*, row_number() OVER (PARTITION BY both_.{block}, both_.x ORDER BY ratio DESC, other.n DESC, target) AS r
            FROM both_ JOIN sizes own ON own.{block} = both_.{block} AND own.x = both_.x JOIN sizes other ON other.{block} = both_.{block} AND other.x = both_.target
            WHERE (own.n < other.n OR (own.n = other.n AND target < both_.x)) {cap}) WHERE r = 1)"""


def shelf(limit: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY {whole('mp3_size')} DESC, {TITLE}, ord) AS rank FROM keyed),
        kept AS (SELECT *, CASE WHEN regexp_matches(artist_key, '^[a-z]') THEN substr(artist_key, 1, 1) ELSE '#' END || '/' || {safe_folder('artist_key')} AS dir, {stem()} AS st,
                 CASE WHEN list_contains(file_types, 'zip') THEN 'zip' WHEN list_contains(file_types, 'mp3') THEN 'mp3' END AS ext FROM ranked WHERE rank <= {limit} AND artist_key NOT IN ('', 'unknown')),
        chosen AS (SELECT k.* FROM kept k JOIN kept b ON b.artist_key = k.artist_key AND b.song_key = k.song_key AND b.rank = 1 WHERE k.rank = 1 OR (b.ext IS NOT NULL AND k.ext IS NOT NULL AND k.st <> b.st)),
        plan AS (SELECT dest, src FROM (SELECT dir || '/' || st || '.' || t AS dest, regexp_replace(path, '\\.[^./]*\\z', '') || '.' || t AS src,
                 row_number() OVER (PARTITION BY dir || '/' || st || '.' || t ORDER BY rank, artist_key, song_key, path) AS r FROM (SELECT *, unnest(file_types) AS t FROM chosen)) WHERE r = 1)"""


def book() -> str:
    return f"""shown AS (SELECT *, {book_display('artist')} AS a, {book_display('song')} AS s FROM tracks WHERE NOT {unknown()}),
        shownk AS (SELECT *, {clean_artist('a')} AS artist_key, {clean_song('s')} AS song_key FROM shown),
        rows_ AS (SELECT *, {details()} AS details FROM shownk WHERE artist_key <> '' AND song_key <> ''),
        best AS (SELECT artist_key, song_key, details, first_ord FROM (SELECT *, min(ord) OVER (PARTITION BY artist_key, song_key) AS first_ord, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY {whole('mp3_size')} DESC, {TITLE}, ord) AS r FROM rows_) WHERE r = 1),
        an AS (SELECT artist_key, a FROM (SELECT artist_key, a, row_number() OVER (PARTITION BY artist_key ORDER BY count(*) DESC, min(ord)) AS r FROM rows_ WHERE a <> '' GROUP BY artist_key, a) WHERE r = 1),
        sn AS (SELECT artist_key, song_key, s FROM (SELECT artist_key, song_key, s, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY count(*) DESC, min(ord)) AS r FROM rows_ WHERE s <> '' GROUP BY artist_key, song_key, s) WHERE r = 1),
        book AS (SELECT an.a AS artist, sn.s AS song, details, lower(strip_accents(an.a)) AS artist_sort, lower(strip_accents(sn.s)) AS song_sort, first_ord FROM best JOIN an USING (artist_key) JOIN sn USING (artist_key, song_key))"""


def flipped(known_name: str = "known") -> str:
    """``flip``: rows of base with the artist that the title names."""
    return f"""turned AS (SELECT *, {uncomma('song')} AS turned FROM base),
        flagged AS ({flags('turned', {'t_known': clean_artist('b.turned'), 's_known': clean_artist('b.song'), 'a_known': clean_artist('b.artist')}, known_name)}),
        flip AS (SELECT *, CASE WHEN t_known THEN turned WHEN s_known THEN song END AS flip, {artist_tokens("nullif(tag_artist, '<not-found>')")} AS tag, {artist_tokens('artist')} AS own FROM flagged)"""


QUEUE = "queue AS (SELECT * FROM keyed WHERE artist_key IN (SELECT artist_key FROM counts WHERE n <= 5) AND path NOT IN (SELECT path FROM state WHERE status = 'ok'))"
RESOLVED = """given AS (SELECT path, artist AS new_artist, song AS new_song FROM resolutions),
    met AS (SELECT t.ord, t.path, t.artist, t.song, g.path IS NOT NULL AS hit, coalesce(new_artist, artist) AS a, coalesce(new_song, song) AS s, t.path IN (SELECT path FROM state WHERE status = 'ok') AS done
            FROM tracks t LEFT JOIN given g USING (path)),
    res AS (SELECT *, hit AND (a IS DISTINCT FROM artist OR s IS DISTINCT FROM song OR NOT done) AS apply_ FROM met)"""
ALIASES = "usable AS (SELECT variant, max(canonical) AS canonical FROM aliases WHERE variant <> '' AND canonical <> '' AND variant <> canonical GROUP BY variant)"


CREDIT = rf"(?i){X.SPACE}+(?:with|and|feat\.?|f\.|ft\.?|featuring){X.SPACE}+"


def chain(passes: list[str]) -> str:
    """Queries over ``tracks`` that return ord, artist and song, each over what the one before it made of the tracks."""
    rows = tracks_sql(spark=False)
    out = passes[0]
    for sql in passes[1:]:
        new = f"SELECT t.* REPLACE (p.artist AS artist, p.song AS song) FROM ({rows}) t JOIN ({out}) p USING (ord)"
        out = sql.replace(f"tracks AS ({rows})", f"tracks AS ({new})", 1)
    return out


def edits_apply() -> str:
    op = "(ord // 3) % 6"
    primary = strip("split_part(raw, '&', 1)")
    step = f"""CASE WHEN ord % 3 <> 0 THEN artist WHEN {op} = 0 THEN song WHEN {op} = 1 THEN 'E' || ord WHEN {op} = 3 THEN '' WHEN {op} = 4 THEN coalesce({uncomma(primary)}, {primary}) WHEN {op} = 5 AND tagged <> '' THEN tagged ELSE artist END AS a,
        CASE WHEN ord % 3 <> 0 THEN song WHEN {op} = 0 THEN artist WHEN {op} = 2 THEN 'E' || ord ELSE song END AS s, CASE WHEN ord % 3 = 0 AND {op} = 4 AND contains(raw, '&') THEN nullif({strip("substr(raw, instr(raw, '&') + 1)")}, '') END AS feature"""
    return q("SELECT ord, CASE WHEN ord % 9 = 0 THEN s ELSE a END AS artist, CASE WHEN ord % 9 = 0 THEN a ELSE s END AS song, feature FROM st",
        f"rw AS (SELECT ord, artist, song, {rx('artist', CREDIT, ' & ')} AS raw, {query_form('tag_artist')} AS tagged FROM tracks)", f"st AS (SELECT ord, {step} FROM rw)")


def searches() -> str:
    def phrase(field: str, value: str) -> str:
        return f"'{field}:\"' || {escape(value)} || '\"'"

    def escape(value: str) -> str:
        return strip(f"replace(replace({value}, chr(92), ' '), '\"', ' ')")

    def ask(shape: str, artist: str, title: str, text: str, answers: int) -> str:
        return f"SELECT '{shape}' AS shape, {artist} AS query_artist, {title} AS query_title, {text} AS text, {answers} AS answers FROM named"

    def pair(by: str, title: str) -> str:
        return f"{phrase('artist', query_form(by))} || ' AND ' || {phrase('recording', plain_form(title))}"

    title = phrase("recording", plain_form("s"))
    asked = [
        ask("direct", "lower(a)", "lower(s)", pair("a", "s"), 5), ask("direct", "lower(s)", "lower(a)", pair("s", "a"), 5), ask("title", "''", "lower(s)", title, 20),
        ask("release", "lower(a)", "lower(s)", f"{title} || ' AND ' || {phrase('release', plain_form('a'))}", 10),
        ask("key", "lower(a)", "lower(s)", f"{phrase('artist', 'a')} || ' AND ' || {phrase('recording', 's')}", 10) + f" WHERE {escape('a')} <> '' AND {escape('s')} <> ''",
    ]
    return q("SELECT shape, query_artist, query_title, min(text) AS text, answers FROM asked GROUP BY ALL", f"named AS (SELECT * FROM (SELECT DISTINCT {strip('artist')} AS a, {strip('song')} AS s FROM tracks) WHERE a <> '' AND s <> '')",
        f"asked AS ({' UNION ALL '.join(asked)})")


def corroborate(side: str = "candidates") -> str:
    def best(name: str, query: tuple, ours: tuple, shape: str = "direct") -> str:
        return f"""{name}m AS (SELECT la, ls, rank, c.artist AS ca, c.title AS ct, {match_form('o.' + ours[0])} AS fa, {match_form('o.' + ours[1])} AS ft, {match_form('c.artist')} AS ga, {match_form('c.title')} AS gt
                FROM prs JOIN {side} c ON c.shape = '{shape}' AND c.query_artist = {query[0]} AND c.query_title = {query[1]}), {name}s AS (SELECT *, {ratio('fa', 'ga')} AS x, {ratio('ft', 'gt')} AS y FROM {name}m),
            {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY la, ls ORDER BY x + y DESC, rank) AS r FROM {name}s WHERE x + y > 0) WHERE r = 1)"""

    # A release's records are taken in their order, by title alone.
    release = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY la, ls ORDER BY rank) AS r FROM es WHERE y >= 88) WHERE r = 1)"
    kind = """CASE WHEN d.x >= 88 AND d.y >= 88 THEN 'ok' WHEN v.x >= 88 AND v.y >= 88 THEN 'swap' WHEN w.x >= 88 AND w.y >= 88 THEN 'title' WHEN d.x >= 70 AND d.y >= 70 THEN 'flag' WHEN coalesce(f.ca, '') <> '' THEN 'suggest' ELSE 'none' END"""
    noted = lambda c: f"CASE {kind} WHEN 'flag' THEN d.{c} WHEN 'suggest' THEN f.{c} END"
    return q("""SELECT t.ord, CASE WHEN kind = 'swap' THEN t.song ELSE t.artist END AS artist, CASE WHEN kind = 'swap' THEN t.artist ELSE t.song END AS song, CASE WHEN kind IS NOT NULL THEN '1' END AS mb_checked, kind AS mb_match, ma AS mb_artist, mt AS mb_title
        FROM tracks t LEFT JOIN asked ON asked.path = t.path LEFT JOIN res USING (la, ls)""", KEYED, COUNTS, QUEUE,
        f"asked AS (SELECT path, {strip('artist')} AS oa, {strip('song')} AS ot, lower({strip('artist')}) AS la, lower({strip('song')}) AS ls FROM queue WHERE {strip('artist')} <> '' AND {strip('song')} <> '')",
        "prs AS (SELECT la, ls, min({'a': oa, 't': ot}) AS o FROM asked GROUP BY ALL)", best("d", ("la", "ls"), ("a", "t")), best("v", ("ls", "la"), ("t", "a")),
        best("w", ("''", "ls"), ("a", "t"), "title"), best("e", ("la", "ls"), ("a", "t"), "release"), release,
        f"res AS (SELECT prs.la, prs.ls, {kind} AS kind, {noted('ca')} AS ma, {noted('ct')} AS mt FROM prs LEFT JOIN d USING (la, ls) LEFT JOIN v USING (la, ls) LEFT JOIN w USING (la, ls) LEFT JOIN first f USING (la, ls))", sides=("state", side))


def reliable(f: str) -> str:
    """The longest words that fragments certainly hold whole."""
    own = words("x")
    part = f"CASE WHEN i = 1 THEN CASE WHEN len({own}) > 1 THEN list_concat({own}[1:1], {own}[2:len({own}) - 1]) ELSE [] END WHEN i = len({f}) THEN CASE WHEN len({own}) > 1 THEN {own}[2:] ELSE [] END ELSE {own}[2:len({own}) - 1] END"
    bare = f"list_distinct(list_filter(list_transform(flatten(list_transform({f}, lambda x, i: {part})), lambda w: {rx('w', "[^A-Za-z0-9']")}), lambda w: length(w) >= 3))"
    return f"list_transform(list_sort(list_transform({bare}, lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda r: r.w)"


def restitch() -> str:
    length = f"list_sum(list_transform(fragments, lambda z: length({equality('z')})))"
    return q("SELECT t.ord, CASE WHEN kind = 'ok' THEN ca ELSE t.artist END AS artist, CASE WHEN kind = 'ok' THEN ct ELSE t.song END AS song, kind AS restitch, CASE WHEN kind = 'suggest' THEN 'suggest' END AS mb_match, CASE WHEN kind = 'suggest' THEN ct END AS mb_title FROM tracks t LEFT JOIN res USING (path)",
        KEYED, COUNTS, known(1), f"stems AS (SELECT path, artist AS own, {clean_artist('artist')} AS own_key, {split_stem(stem())} AS p FROM tracks WHERE path NOT IN (SELECT path FROM state WHERE status = 'ok'))",
        "runs AS (SELECT path, own, own_key, p, j, array_to_string(p[1:j], ' ') AS run FROM (SELECT *, unnest(range(1, len(p))) AS j FROM stems WHERE len(p) >= 3))", f"keyedr AS (SELECT *, {clean_artist('run')} AS rk FROM runs)",
        "joined AS (SELECT path, run AS artist, p[j + 1:] AS fr FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY j DESC) AS r FROM keyedr WHERE j >= 2 AND rk IN (SELECT k FROM known)) WHERE r = 1)",
        "owned AS (SELECT path, own AS artist, p[j + 1:] AS fr FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY j) AS r FROM keyedr WHERE rk = own_key AND own_key IN (SELECT k FROM known)) WHERE r = 1)",
        "asked AS (SELECT path, artist, list_filter(fr, lambda x: x <> '') AS fragments FROM (SELECT * FROM joined UNION ALL SELECT * FROM owned WHERE path NOT IN (SELECT path FROM joined)))",
        f"q1 AS (SELECT *, {reliable('fragments')} AS w FROM asked WHERE len(fragments) > 0)", "cand AS (SELECT lower(artist) AS qa, lower(array_to_string(w, ' ')) AS qt, min(artist) AS ca, min('Heaven Is A Place On ' || w[1]) AS ct FROM q1 WHERE len(w) > 0 GROUP BY ALL)",
        f"m1 AS (SELECT path, fragments, ca, ct, {match_form('artist')} AS fa, {match_form('ca')} AS ga FROM q1 LEFT JOIN cand ON qa = lower(artist) AND qt = lower(array_to_string(w, ' ')) AND len(w) > 0)",
        f"res AS (SELECT path, ca, ct, CASE WHEN ca IS NULL OR {ratio('fa', 'ga')} < 88 OR NOT {fits('fragments', 'ct')} THEN 'none' WHEN {length} >= 10 THEN 'ok' ELSE 'suggest' END AS kind FROM m1)", sides=("state",))


def detect_keys() -> str:
    return q("""SELECT ord, CASE WHEN work THEN fk ELSE key END AS key, CASE WHEN work THEN CASE WHEN fk IS NOT NULL THEN format('{:.3f}', fc) END ELSE key_confidence END AS key_confidence, CASE WHEN work THEN fs ELSE key_source END AS key_source,
        CASE WHEN work THEN fd END AS key_detail, CASE WHEN work THEN code END AS key_camelot FROM (SELECT *, """ + camelot("fk") + """ AS code FROM fu)""", f"heard AS ({ks_key()})",
        "ov AS (SELECT name, max(key) AS ok FROM overrides GROUP BY name)", f"net AS (SELECT DISTINCT lower({strip('artist')}) AS qa, lower({strip('song')}) AS qt FROM tracks WHERE ord % 4 = 1 AND artist IS NOT NULL)",
        f"""sg AS (SELECT t.ord, t.key, t.key_confidence, t.key_source, (list_contains(file_types, 'mp3') OR list_contains(file_types, 'zip')) AND (ov.name IS NOT NULL OR t.ord % 7 <> 0) AS work, {normalize_key('ov.ok')} AS o,
            CASE WHEN ov.name IS NULL THEN {normalize_key('tag_key')} END AS t, CASE WHEN ov.name IS NULL THEN h.key END AS h, h.confidence AS c, CASE WHEN ov.name IS NULL AND net.qa IS NOT NULL AND (h.key IS NULL OR h.confidence < 0.85) THEN 'C major' END AS n
            FROM tracks t LEFT JOIN ov ON ov.name = lower({strip("artist || ' - ' || song")}) LEFT JOIN heard h ON h.vec_id = t.ord LEFT JOIN net ON net.qa = lower({strip('t.artist')}) AND net.qt = lower({strip('t.song')}))""",
        f"fu AS (SELECT *, {FUSED['key']} AS fk, {FUSED['confidence']} AS fc, {FUSED['source']} AS fs, {FUSED['detail']} AS fd FROM sg)", sides=("overrides",))


def oracle_sql() -> dict[str, str]:
    found = _oracles()
    steps = [found[n] for n in ("clean_pass", "trailing_article_pass", "tag_fill", "uncomma_pass", "ungroup", "fuzz_merge", "fuzz_song_merge")]
    found["all_clean"] = f"SELECT f.ord, f.artist, f.song, c.style, u.feature FROM ({chain(steps)}) f JOIN ({steps[0]}) c USING (ord) JOIN ({chain(steps[:5])}) u USING (ord)"
    return found


def _oracles() -> dict[str, str]:
    named = f"named AS (SELECT * FROM keyed WHERE NOT {unknown()} AND song_key <> '')"
    reps = lambda most: f"reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY {TITLE}, ord) AS rn FROM keyed WHERE artist_key IN (SELECT artist_key FROM counts WHERE n <= {most})) WHERE rn = 1)"
    tag_name = strip(rx("coalesce(tag_artist, '')", X.TAG_SUFFIX))
    open_tag = f"({unknown(strip('artist'))} AND coalesce(tag_artist, '') <> '<not-found>' AND {tag_name} <> '')"
    reason = rf"CASE WHEN regexp_matches({tag_name}, '^\p{{Nd}}+\z') THEN 'numeric' WHEN regexp_matches({tag_name}, '^[A-Za-z]+\p{{Nd}}{{2,}}\z') THEN 'catalog-id' END"
    prefix = "split_part(artist, '&', 1)"
    part = lambda i: f"string_split(replace({stem()}, '_', ' '), ' - ')[{i}]"
    head = lambda i: f"split_part({clean_artist(f'p{i}')}, '&', 1)"
    song_ = "replace(song, '_', ' ')"
    dash, tight, wide, comma = f"string_split({song_}, ' - ')", each(f"string_split({song_}, '-')", strip), f"string_split({song_}, '  ')", each(f"string_split({song_}, ',')", strip)
    two = lambda xs: f"{{'a': {xs}[-2], 's': {xs}[-1]}}"
    swap_if = "NOT (lower(artist) IN ('unknown', '')) AND song <> '' AND NOT contains(artist, chr(92)) AND NOT a_known AND flip IS NOT NULL AND NOT (flip = song AND len(tag) > 0 AND tag = own) AND ((len(tag) > 0 AND tag = stok) OR flip <> song)"
    tag_swaps = f"swaps AS (SELECT *, {swap_if} AS swap_ FROM (SELECT *, {artist_tokens('song')} AS stok FROM flip))"
    docs = "SELECT sha256(k) AS digest, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS k FROM documents) GROUP BY k HAVING count(*) > 1"
    return {
        "best_copy": q(f"SELECT artist_key, song_key, ord, path FROM (SELECT *, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY {whole('mp3_size')} DESC, {TITLE}, ord) AS r FROM keyed) WHERE r = 1", KEYED),
        "ranked_versions": q(f"SELECT artist_key, song_key, CAST(rank AS INT) AS rank, ord FROM (SELECT *, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY {whole('mp3_size')} DESC, {TITLE}, ord) AS rank FROM keyed) WHERE rank <= 3", KEYED),
        "known_artists": q("SELECT k AS artist_key FROM known", KEYED, COUNTS, known(3)),
        "thin_artists": q("SELECT * FROM counts WHERE n <= 5", KEYED, COUNTS),
        "single_artist_reps": q("SELECT artist_key, song_key, ord FROM reps", KEYED, COUNTS, reps(3)),
        "majority_spelling": q("SELECT * FROM spelled", KEYED, MAJORITY),
        "subtree_counts": q("SELECT CAST(CASE grouping(letter, artist_key, song_key) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS level, letter, artist_key, song_key, count(*) AS n FROM lettered GROUP BY ROLLUP (letter, artist_key, song_key)", KEYED),
        "folder_counts": q("SELECT folder, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS folder FROM tracks) GROUP BY folder"),
        "song_index": q(f"SELECT {letter('song_key')} AS letter, song_key, artist, count(*) AS n FROM keyed WHERE NOT {unknown()} GROUP BY ALL", KEYED),
        "browse_letters": q("SELECT letter AS name, count(*) AS n FROM lettered GROUP BY letter", KEYED),
        "browse_artists": q("SELECT artist_key AS name, count(*) AS n FROM lettered WHERE letter = 'r' GROUP BY artist_key", KEYED),
        "distinct_pairs": q(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT artist_key, song_key FROM keyed WHERE NOT {unknown()})) AS pairs, (SELECT count(*) FROM tracks) AS files", KEYED),
        "library_totals": q(f"""SELECT count(*) AS files, (SELECT count(*) FROM prs) AS distinct_songs, (SELECT count(DISTINCT artist_key) FROM prs) AS distinct_artists, count(*) FILTER ({unknown()}) AS unknown, (SELECT CAST(sum(n - 1) AS BIGINT) FROM prs) AS duplicates,
            CAST(sum({number('length_seconds')}) AS BIGINT) AS seconds, CAST(sum({number('mp3_size')} + {number('cdg_size')}) AS BIGINT) AS bytes, count(*) FILTER (coalesce(length_seconds, '') <> '') AS detailed,
            CAST(sum({number('length_seconds')}) // count(*) FILTER (coalesce(length_seconds, '') <> '') AS BIGINT) AS avg_seconds,
            CAST(sum({number('bitrate_bps')}) // count(*) FILTER ({number('bitrate_bps')} <> 0) // 1000 AS BIGINT) AS avg_kbps FROM tracks""", KEYED, named, "prs AS (SELECT artist_key, song_key, count(*) AS n FROM named GROUP BY ALL)"),
        "format_breakdown": q("SELECT format, count(*) AS n FROM (SELECT unnest(file_types) AS format FROM tracks) GROUP BY format"),
        "decades": q(f"SELECT CAST({year('tag_year')} // 10 * 10 AS INT) AS decade, count(*) AS n FROM tracks WHERE {year('tag_year')} IS NOT NULL GROUP BY decade"),
        "top_artists": q("SELECT artist, songs FROM (SELECT artist_key, count(DISTINCT song_key) AS songs, min(ord) AS o FROM named GROUP BY artist_key ORDER BY songs DESC, o LIMIT 15) JOIN spelled USING (artist_key)", KEYED, named, MAJORITY.replace("FROM keyed", "FROM named")),
        "most_duplicated": q("SELECT title, copies FROM (SELECT arg_min(artist || ' - ' || coalesce(song, ''), ord) AS title, count(*) AS copies, min(ord) AS o FROM named GROUP BY artist_key, song_key HAVING count(*) >= 2 ORDER BY copies DESC, o LIMIT 10)", KEYED, named),
        "alias_usage": q("SELECT variant, canonical, n FROM (SELECT artist AS variant, count(*) AS n, min(ord) AS o FROM tracks GROUP BY artist) JOIN usable USING (variant) ORDER BY n DESC, o LIMIT 80", ALIASES, sides=("aliases",)),
        "clean_artist": scalar("artist", "artist_key", clean_artist),
        "clean_song": scalar("song", "song_key", clean_song),
        "safe_folder": scalar("artist", "folder", safe_folder),
        "letter_bucket": scalar("artist", "letter", lambda c: letter(clean_artist(c))),
        "book_display": scalar("song", "display", book_display),
        "trailing_article": scalar("artist", "fixed", fix_article),
        "uncomma": scalar("artist", "turned", uncomma),
        "artist_tokens": scalar("artist", "tokens", lambda c: f"array_to_string({artist_tokens(c)}, '|')"),
        "query_form": scalar("artist", "form", query_form),
        "match_form": scalar("artist", "form", match_form),
        "escape_phrase": scalar("artist", "phrase", lambda c: strip(f"replace(replace({c}, chr(92), ' '), '\"', ' ')")),
        "strip_echo": q(f"SELECT ord, {strip_echo('artist', 'song')} AS stripped FROM tracks"),
        "book_details": q(f"SELECT ord, {details()} AS details FROM tracks"),
        "metadata_line": q("SELECT ord, 'sec ' || coalesce(length_seconds, '') || ', bitrate ' || CAST(CAST(coalesce(bitrate_bps, '0') AS BIGINT) // 1000 AS VARCHAR) || ' m.sz ' || CAST(CAST(coalesce(mp3_size, '0') AS BIGINT) // 1000 AS VARCHAR) || 'k c.sz ' || CAST(CAST(cdg_size AS BIGINT) // 1000 AS VARCHAR) || 'k m# ' || substr(mp3_hash, 1, 6) || ' c# ' || substr(mp3_hash, 1, 6) AS line FROM tracks WHERE mp3_size IS NULL OR TRY_CAST(mp3_size AS BIGINT) IS NOT NULL"),
        "parse_stem": q(f"SELECT ord, p.artist AS artist, p.song AS song FROM (SELECT ord, {parse(stem())} AS p FROM tracks)"),
        "split_stem": q(f"SELECT ord, array_to_string({split_stem(stem())}, '|') AS parts FROM tracks"),
        "catalog_segment": q(f"SELECT ord, {is_catalog('song')} AS strict, {is_catalog('song', True)} AS relaxed FROM tracks"),
        "restitch_fragments": q(f"SELECT ord, {fits('p[3:]', 'title')} AS fits FROM (SELECT ord, {split_stem(stem())} AS p, 'Heaven Is A Place On ' || split_part(path, '/', 2) AS title FROM tracks)"),
        "rejoin_artist": q(f"SELECT path, artist, array_to_string(rest, '|') AS rest FROM (SELECT path, artist, rest, row_number() OVER (PARTITION BY path ORDER BY k DESC) AS r FROM runs JOIN known ON known.k = {clean_artist('artist')}) WHERE r = 1",
            KEYED, COUNTS, known(1), f"stems AS (SELECT path, {split_stem(stem())} AS p FROM tracks)", "cuts AS (SELECT path, p, unnest(range(2, len(p))) AS k FROM stems)", "runs AS (SELECT path, k AS k, array_to_string(p[1:k], ' ') AS artist, p[k + 1:] AS rest FROM cuts)").replace("SELECT path, artist, rest, row_number() OVER (PARTITION BY path ORDER BY k DESC)", "SELECT path, artist, rest, row_number() OVER (PARTITION BY path ORDER BY runs.k DESC)"),
        "clean_pass": q("SELECT ord, CASE WHEN fix AND again.artist <> '' THEN again.artist WHEN fix AND " + equality("artist") + " = " + equality("again.song") + " THEN 'Unknown' ELSE artist END AS artist, CASE WHEN fix THEN again.song ELSE song END AS song, style, track_no, CASE WHEN fix THEN coalesce(catalog_id, own) ELSE catalog_id END AS catalog_id FROM f", clean_steps()),
        "trailing_article_pass": q(f"SELECT ord, {fix_article('artist')} AS artist, {fix_article('song')} AS song FROM base", BASE),
        "tag_fill": q(f"SELECT ord, CASE WHEN {open_tag} AND {reason} IS NULL THEN {tag_name} ELSE artist END AS artist, song, CASE WHEN {open_tag} AND {reason} IS NULL THEN 'tag' END AS artist_from, CASE WHEN {open_tag} AND {reason} IS NOT NULL THEN {tag_name} END AS artist_review, CASE WHEN {open_tag} THEN {reason} END AS artist_review_reason FROM base", BASE),
        "alias_rename": q("SELECT ord, coalesce(canonical, artist) AS artist, song FROM tracks LEFT JOIN usable ON variant = artist", ALIASES, sides=("aliases",)),
        "uncomma_pass": q("SELECT ord, coalesce(canonical, CASE WHEN t_known THEN turned END, artist) AS artist, song FROM fl LEFT JOIN usable ON variant = artist", KEYED, COUNTS, known(1), BASE, ALIASES, f"tu AS (SELECT *, {uncomma('artist')} AS turned FROM base)", f"fl AS ({flags('tu', {'t_known': clean_artist('b.turned')})})", sides=("aliases",)),
        "ungroup": q("SELECT t.ord, coalesce(c.artist, t.artist, '') AS artist, coalesce(t.song, '') AS song, c.feature FROM tracks t LEFT JOIN changes c USING (path)", KEYED, COUNTS, known(1), MAJORITY, reps(9),
            f"pre AS (SELECT path, coalesce({uncomma(clean_artist(prefix))}, {clean_artist(prefix)}) AS pk, {strip("substr(artist, instr(artist, '&') + 1)")} AS feature FROM reps WHERE contains(artist, '&'))", "changes AS (SELECT pre.path, spelled.artist, feature FROM pre JOIN known ON known.k = pk JOIN spelled ON spelled.artist_key = pk)"),
        "unswap": q("SELECT ord, CASE WHEN path IN (SELECT path FROM hits) THEN song ELSE artist END AS artist, CASE WHEN path IN (SELECT path FROM hits) THEN artist ELSE song END AS song FROM base", KEYED, COUNTS, known(3), BASE, reps(3),
            f"sus AS (SELECT path, regexp_replace(path, '/[^/]*\\z', '') AS folder FROM reps WHERE {clean_artist("coalesce(song, '')")} IN (SELECT k FROM known) AND artist_key NOT IN (SELECT k FROM known))", "hits AS (SELECT path FROM sus WHERE folder IN (SELECT folder FROM sus GROUP BY folder HAVING count(*) > 3))"),
        "refresh": q(f"""SELECT ord, CASE WHEN l AND n = 2 AND f1 AND NOT f2 THEN p1 WHEN l AND n = 2 AND f2 AND NOT f1 THEN p2 WHEN l AND n NOT IN (2, 3) AND again.artist <> '' AND again.song <> '' AND {unknown()} THEN again.artist ELSE artist END AS artist,
            CASE WHEN l AND n = 2 AND f1 AND NOT f2 THEN p2 WHEN l AND n = 2 AND f2 AND NOT f1 THEN p1 WHEN l AND n NOT IN (2, 3) AND again.artist <> '' AND again.song <> '' AND {unknown()} THEN again.song ELSE song END AS song FROM (SELECT *, w1k OR h1k AS f1, w2k OR h2k AS f2 FROM fl)""", KEYED, COUNTS, known(5), BASE,
            f"st AS (SELECT *, ord % 10 <> 9 AS l, len(string_split(replace({stem()}, '_', ' '), ' - ')) AS n, {part(1)} AS p1, {part(2)} AS p2, {parse(stem())} AS again FROM base)",
            f"pk AS (SELECT *, CASE WHEN n = 2 THEN {clean_artist('p1')} END AS k1, CASE WHEN n = 2 THEN {clean_artist('p2')} END AS k2, CASE WHEN n = 2 THEN coalesce({uncomma(head(1))}, {head(1)}) END AS h1, CASE WHEN n = 2 THEN coalesce({uncomma(head(2))}, {head(2)}) END AS h2 FROM st)",
            f"fl AS ({flags('pk', {'w1k': 'b.k1', 'h1k': 'b.h1', 'w2k': 'b.k2', 'h2k': 'b.h2'})})"),
        "fix_unknown": q("SELECT ord, CASE WHEN fa THEN pair.a WHEN fb AND both_ THEN pair.s ELSE artist END AS artist, CASE WHEN fa THEN pair.s WHEN fb AND both_ THEN pair.a ELSE song END AS song FROM fl", KEYED, COUNTS, known(5), BASE,
            f"""pr AS (SELECT *, NOT contains({song_}, '-') AND contains({song_}, '  ') AS both_, CASE WHEN NOT {unknown()} THEN NULL WHEN contains({song_}, ' - ') THEN CASE WHEN len({dash}) IN (2, 3, 4) THEN {two(dash)} END
                WHEN contains({song_}, '-') THEN CASE WHEN len({tight}) IN (2, 3) THEN {two(tight)} END WHEN contains({song_}, '  ') THEN CASE WHEN len({wide}) = 2 THEN {two(wide)} END
                WHEN contains({song_}, ',') THEN CASE WHEN len({comma}) = 2 THEN {two(comma)} END END AS pair FROM base)""", f"fl AS ({flags('pr', {'fa': clean_artist('b.pair.a'), 'fb': clean_artist('b.pair.s')})})"),
        "fuzzy_artist_pairs": q("SELECT letter, a, b, round(ratio, 6) AS ratio FROM similar_", KEYED, pairs("letter", "artist_key", 90.0)),
        "fuzzy_song_pairs": q("SELECT artist_key, a, b, round(ratio, 6) AS ratio FROM similar_", KEYED, pairs("artist_key", "song_key", 85.0)),
        "fuzz_merge": q("SELECT t.ord, CASE WHEN best.x IS NULL THEN coalesce(t.artist, '') ELSE coalesce(spelled.artist, best.target) END AS artist, coalesce(t.song, '') AS song FROM lettered t LEFT JOIN best ON best.letter = t.letter AND best.x = t.artist_key LEFT JOIN spelled ON spelled.artist_key = best.target", KEYED, MAJORITY, pairs("letter", "artist_key", 90.0), targets("letter", "artist_key", 5)),
        "fuzz_song_merge": q("SELECT t.ord, coalesce(t.artist, '') AS artist, CASE WHEN best.x IS NULL THEN coalesce(t.song, '') ELSE coalesce(sp.song, best.target) END AS song FROM lettered t LEFT JOIN best ON best.artist_key = t.artist_key AND best.x = t.song_key LEFT JOIN sp ON sp.artist_key = best.artist_key AND sp.song_key = best.target", KEYED, pairs("artist_key", "song_key", 85.0), targets("artist_key", "song_key", None),
            "sp AS (SELECT artist_key, song_key, song FROM (SELECT artist_key, song_key, song, row_number() OVER (PARTITION BY artist_key, song_key ORDER BY count(*) DESC, min(ord)) AS r FROM keyed WHERE coalesce(song, '') <> '' GROUP BY artist_key, song_key, song) WHERE r = 1)"),
        "review_queue": q("SELECT ord FROM keyed WHERE (artist_key IN (SELECT artist_key FROM counts WHERE n <= 5) OR artist_key = 'small ring') AND path NOT IN (SELECT path FROM state WHERE status = 'ok')", KEYED, COUNTS, sides=("state",)),
        "tag_review": q("SELECT path FROM flip WHERE path IN (SELECT path FROM queue) AND len(own) > 0 AND own = tag AND (a_known OR flip IS NULL)", KEYED, COUNTS, known(3), BASE, flipped(), QUEUE, sides=("state",)),
        "tag_swap": q("SELECT b.ord, CASE WHEN swap_ THEN flip ELSE t.artist END AS artist, CASE WHEN swap_ THEN b.artist ELSE t.song END AS song FROM swaps b JOIN tracks t USING (path)", KEYED, COUNTS, known(3), BASE, flipped(), tag_swaps),
        "tag_swap_settled": q("SELECT path FROM swaps WHERE swap_", KEYED, COUNTS, known(3), BASE, flipped(), tag_swaps),
        "resolutions_apply": q("SELECT ord, a AS artist, s AS song, CASE WHEN apply_ THEN 'resolutions' END AS artist_from FROM res", RESOLVED, sides=("state", "resolutions")),
        "resolutions_settled": q("SELECT path FROM res WHERE apply_", RESOLVED, sides=("state", "resolutions")),
        "resolutions_report": q("SELECT r.path, CASE WHEN t.path IS NULL THEN 'missing' WHEN coalesce(r.artist, t.artist) IS NOT DISTINCT FROM t.artist AND coalesce(r.song, t.song) IS NOT DISTINCT FROM t.song AND r.path IN (SELECT path FROM state WHERE status = 'ok') THEN 'unchanged' ELSE 'apply' END AS outcome, t.artist AS old_artist, t.song AS old_song, coalesce(r.artist, t.artist) AS new_artist, coalesce(r.song, t.song) AS new_song FROM resolutions r LEFT JOIN tracks t USING (path)", sides=("state", "resolutions")),
        "candidate_best": q("SELECT ord, round(asim, 6) AS artist_sim, round(tsim, 6) AS title_sim, mb_artist, mb_title FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY asim + tsim DESC, rank) AS r FROM sc WHERE asim + tsim > 0) WHERE r = 1",
            f"asked AS (SELECT ord, artist AS oa, song AS os, lower({strip('artist')}) AS qa, lower({strip('song')}) AS qt FROM tracks WHERE artist IS NOT NULL)",
            f"mt AS (SELECT ord, rank, {match_form('oa')} AS fa, {match_form('os')} AS ft, {match_form('c.artist')} AS ga, {match_form('c.title')} AS gt, c.artist AS mb_artist, c.title AS mb_title FROM asked JOIN candidates c ON c.shape = 'direct' AND c.query_artist = qa AND c.query_title = qt)",
            f"sc AS (SELECT *, {ratio('fa', 'ga')} AS asim, {ratio('ft', 'gt')} AS tsim FROM mt)", sides=("candidates",)),
        "ks_key": ks_key(),
        "normalize_key": q(f"SELECT ord, {normalize_key('raw')} AS key FROM raws", raw_keys()),
        "camelot": q(f"SELECT ord, {camelot('raw')} AS code FROM raws", raw_keys()),
        "keys_agree": q(f"SELECT ord, coalesce({normalize_key('tag_key')} = {normalize_key('key')}, false) AS agree FROM tracks"),
        "key_fusion": fused(),
        "key_emit": q(f"SELECT ord, {emit('key_source', 'coalesce(TRY_CAST(key_confidence AS DOUBLE), 0.0)')} AS emit FROM tracks"),
        "key_index_fields": q(f"SELECT ord, CASE WHEN e THEN key END AS key, CASE WHEN e THEN round(c, 3) END AS key_confidence, CASE WHEN e THEN key_source END AS key_source, CASE WHEN e THEN nullif(tag_key, '') END AS key_camelot FROM (SELECT *, coalesce(key, '') <> '' AND {emit('key_source', 'c')} AS e FROM (SELECT *, coalesce(TRY_CAST(nullif(key_confidence, '') AS DOUBLE), 0.0) AS c FROM tracks))"),
        "key_report": q(f"SELECT key_source, count(*) AS n, count(*) FILTER ({emit('key_source', "coalesce(TRY_CAST(nullif(key_confidence, '') AS DOUBLE), 0.0)")}) AS emitted FROM tracks GROUP BY key_source"),
        "online_keys": q("SELECT query_artist, query_title, arg_min(key, r) FILTER (r <= 5 AND key IS NOT NULL) AS key FROM (SELECT *, row_number() OVER (PARTITION BY query_artist, query_title ORDER BY ord) AS r FROM fnd) GROUP BY ALL", "fnd AS (SELECT ord, lower(artist) AS query_artist, split_part(path, '/', 2) AS query_title, CASE WHEN ord % 3 = 0 THEN 'A minor' END AS key FROM tracks WHERE artist IS NOT NULL AND ord % 30 + 75 >= 85)"),
        "export_plan": q("SELECT dest, src FROM plan", KEYED, shelf(2)),
        "stale_files": q("SELECT dest || '.old' AS path FROM plan WHERE dest || '.old' NOT IN (SELECT dest FROM plan)", KEYED, shelf(1)),
        "songbook_rows": q("SELECT artist, song, details, artist_sort, song_sort FROM book", book()),
        "songbook_search": q("SELECT artist, song, (SELECT count(*) FROM hits) AS total FROM (SELECT * FROM hits ORDER BY artist_sort, song_sort, first_ord LIMIT 40)", book(), "hits AS (SELECT * FROM book WHERE contains(artist_sort || ' ' || song_sort, 'ring') AND contains(artist_sort || ' ' || song_sort, 'sm'))"),
        "auto_clean": q(f"SELECT ord, coalesce({uncomma('primary_')}, primary_) AS artist, feature FROM (SELECT ord, {strip("split_part(raw, '&', 1)")} AS primary_, CASE WHEN contains(raw, '&') THEN {strip("substr(raw, instr(raw, '&') + 1)")} END AS feature FROM (SELECT ord, {rx('artist', CREDIT, ' & ')} AS raw FROM tracks))"),
        "edits_apply": edits_apply(),
        "corroborate": corroborate(),
        "corroborate_shapes": corroborate("answers"),
        "searches": searches(),
        "detect_keys": detect_keys(),
        "reliable_words": q(f"SELECT ord, array_to_string({reliable('f')}, '|') AS words FROM (SELECT ord, {split_stem(stem())}[2:] AS f FROM tracks)"),
        "restitch": restitch(),
        "scan": q(f"""SELECT path, CASE WHEN path LIKE '%.zip' THEN 'zip' WHEN regexp_replace(path, '\\.[^./]*\\z', '') IN (SELECT regexp_replace(path, '\\.[^./]*\\z', '') FROM tracks WHERE list_contains(file_types, 'mp3')) THEN 'mp3|cdg' ELSE 'cdg' END AS file_types,
            CASE WHEN coalesce(canonical, p.artist) = '' THEN 'Unknown' ELSE coalesce(canonical, p.artist) END AS artist, p.song AS song FROM (SELECT path, {parse(stem())} AS p FROM tracks WHERE ord % 4 <> 0) LEFT JOIN usable ON variant = p.artist""", ALIASES, sides=("aliases",)),
        "scan_swapped": q(f"""SELECT 'song-artist/' || path AS path, CASE WHEN path LIKE '%.zip' THEN 'zip' WHEN regexp_replace(path, '\\.[^./]*\\z', '') IN (SELECT regexp_replace(path, '\\.[^./]*\\z', '') FROM tracks WHERE list_contains(file_types, 'mp3')) THEN 'mp3|cdg' ELSE 'cdg' END AS file_types,
            CASE WHEN p.song = '' THEN 'Unknown' ELSE p.song END AS artist, p.artist AS song FROM (SELECT path, {parse(stem())} AS p FROM tracks)"""),
        "edits_accept": q(f"SELECT ord, CASE WHEN take AND {equality('ma')} <> {equality('a')} THEN ma ELSE a END AS artist, CASE WHEN take AND mt <> '' AND {equality('mt')} <> {equality('s')} THEN mt ELSE s END AS song FROM (SELECT *, ma <> '' AS take FROM sug)",
            "sug AS (SELECT ord, coalesce(artist, '') AS a, coalesce(song, '') AS s, coalesce(CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN upper(artist) || '!' ELSE 'New ' || ord END, '') AS ma, coalesce(CASE ord % 3 WHEN 0 THEN NULL WHEN 1 THEN upper(song) || '.' ELSE 'Title ' || ord END, '') AS mt FROM tracks)"),
        "credit_name": q(f"SELECT ord, {strip("coalesce(artist, '') || ' & ' || CASE WHEN ord % 5 > 0 THEN 'W' || ord ELSE 'Other' END")} AS name FROM tracks"),
        "playable_ext": q("SELECT ord, CASE WHEN list_contains(file_types, 'zip') THEN 'zip' WHEN list_contains(file_types, 'mp3') THEN 'mp3' END AS ext FROM tracks"),
        "stored_round_trip": q("SELECT path, array_to_string(file_types, '|') AS file_types, coalesce(artist, '') AS artist, coalesce(song, '') AS song, mp3_hash, mp3_size, cdg_size, tag_artist, CASE WHEN ord % 7 <> 0 THEN tag_year END AS tag_year, key FROM tracks"),
        "snapshots": q("SELECT path, artist, 'Second ' || ord AS song, ord FROM tracks"),
        "changed_files": q("SELECT path, CAST(ord * 10 + 1700000000 AS VARCHAR) AS src_mtime, CAST(ord * 10 AS VARCHAR) AS src_size FROM tracks WHERE ord % 3 = 0 OR ord % 5 = 0"),
        "export_index": q("""SELECT b.file AS path, b.artist, b.song AS title, b.duration, b.k AS key, b.kc AS key_confidence, CAST(coalesce(n, 0) AS INT) AS n_versions, versions FROM playable b
            LEFT JOIN (SELECT artist_key, song_key, count(*) AS n, string_agg(concat_ws('/', file, label, CAST(duration AS VARCHAR), k), '|' ORDER BY rank) AS versions FROM playable WHERE rank > 1 GROUP BY ALL) v USING (artist_key, song_key) WHERE b.rank = 1""", KEYED, shelf(3),
            f"""keyed_files AS (SELECT *, coalesce(key, '') <> '' AND {emit('key_source', "coalesce(TRY_CAST(nullif(key_confidence, '') AS DOUBLE), 0.0)")} AS e FROM chosen WHERE ext IS NOT NULL),
            playable AS (SELECT artist_key, song_key, rank, artist, song, dir || '/' || st || '.' || ext AS file, {number('length_seconds')} AS duration, split_part(regexp_replace(path, '/[^/]*\\z', ''), '/', -1) AS label,
                CASE WHEN e THEN key END AS k, CASE WHEN e THEN round(coalesce(TRY_CAST(nullif(key_confidence, '') AS DOUBLE), 0.0), 3) END AS kc FROM keyed_files)"""),
        "upsert": q("SELECT path, CASE WHEN ord % 6 = 0 THEN 'Third' WHEN ord % 3 = 0 THEN 'Second' ELSE artist END AS artist, song, CASE WHEN ord % 2 = 0 THEN ord ELSE ord + 100000 END AS ord FROM tracks WHERE ord % 2 = 0 OR ord % 3 = 0"),
        "doc_duplicates": docs,
    }
