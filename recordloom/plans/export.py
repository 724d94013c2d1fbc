"""Export: what is kept, where it goes, the index for players and the songbook."""

from __future__ import annotations

import html
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import key_index_fields
from ..functions.similarity import fold, to_ascii
from ..operators import groups
from ..schema import meta, with_meta
from ..tables import ship

# Rows a search shows, the label of a version without a folder, the page's title.
SEARCH_LIMIT = 400
ALTERNATE = "Alternate"
BOOK_TITLE = "Karaoke Songbook"


def _shelf(rows: DataFrame) -> DataFrame:
    """Ranked rows with the folder, stem and playable extension of their files."""
    key = F.col("artist_key")
    prefix = F.when(F.substring(key, 1, 1).rlike("^[a-z]"), F.substring(key, 1, 1)).otherwise("#")
    return rows.where(~key.isin("", "unknown")).withColumns({
        "_dir": F.concat_ws("/", prefix, X.safe_folder(key)), "_stem": X.stem("path"), "_ext": X.playable_ext("file_types"),
    })


def _versions(tracks: DataFrame, limit: int) -> DataFrame:
    """The kept copies of each pair, best first, with the best one's stem; the others only if they can be played and
    have another stem."""
    rows = with_meta(tracks, "mp3_size", "length_seconds", "key", "key_confidence", "key_source", "key_camelot")
    ranked = _shelf(groups.ranked_versions(rows, limit))
    # The same partitions as the ranks, of ``limit`` rows a pair at most: no further shuffle.
    w = Window.partitionBy("artist_key", "song_key").orderBy("rank")
    kept = ranked.withColumns({"_best": F.first("_stem").over(w), "_best_ext": F.first("_ext").over(w)})
    return kept.where("rank = 1 or (_best_ext is not null and _ext is not null and _stem <> _best)")


def export_plan(tracks: DataFrame, limit: int = 1) -> DataFrame:
    """(dest, src): the files to be copied, by path below the output folder; of several sources of one destination
    the best-ranked, then the smallest pair, stays."""
    files = _versions(tracks, limit).select("artist_key", "song_key", "rank", "path", "_dir", "_stem", F.explode("file_types").alias("_type"))
    rows = files.select(F.concat(F.col("_dir"), F.lit("/"), F.col("_stem"), F.lit("."), F.col("_type")).alias("dest"), X.with_suffix("path", F.col("_type")).alias("src"), F.struct("rank", "artist_key", "song_key", "path").alias("_o"))
    return rows.groupBy("dest").agg(F.min_by("src", "_o").alias("src"))


def export_index(tracks: DataFrame, limit: int = 1) -> DataFrame:
    """One row an exported pair that can be played: path, artist, title, duration, key fields and other versions."""
    kept = _versions(tracks, limit).where(F.col("_ext").isNotNull())
    seconds = X.number("length_seconds")
    keys = key_index_fields("key", "key_confidence", "key_source", "key_camelot")
    label = F.when(X.folder("path") == F.col("path"), ALTERNATE).otherwise(F.coalesce(F.nullif(F.substring_index(X.folder("path"), "/", -1), F.lit("")), F.lit(ALTERNATE)))
    rows = kept.select("artist_key", "song_key", "rank", "artist", "song", F.concat(F.col("_dir"), F.lit("/"), F.col("_stem"), F.lit("."), F.col("_ext")).alias("file"), seconds.alias("duration"), label.alias("label"), keys.alias("k"))
    fields = [F.col(f"k.{n}").alias(n) for n in ("key", "key_confidence", "key_source", "key_camelot")]
    other = F.when(F.col("rank") > 1, F.struct("rank", F.col("file").alias("path"), "label", "duration", *fields))
    out = rows.groupBy("artist_key", "song_key").agg(  # ``limit`` rows a group at most
        F.min_by(F.struct("rank", F.col("file").alias("path"), "artist", F.col("song").alias("title"), "duration", *fields), "rank").alias("b"),
        F.array_sort(F.collect_list(other)).alias("v"),
    )
    versions = F.transform("v", lambda v: v.dropFields("rank"))
    best = [F.col(f"b.{n}").alias(n) for n in ("path", "artist", "title", "duration", "key", "key_confidence", "key_source", "key_camelot")]
    return out.where("b.rank = 1").select(*best, F.when(F.size("v") > 0, versions).alias("versions"))


def index_json(index: DataFrame) -> DataFrame:
    """(path, json): a JSON object a pair, without null fields."""
    return index.select("path", F.to_json(F.struct(*index.columns)).alias("json"))


def stale_files(listing: DataFrame, plan: DataFrame) -> DataFrame:
    """(path): files of ``listing`` (path below the output folder) three levels deep that the plan doesn't want."""
    deep = listing.where(F.size(F.split("path", "/")) == 3)
    return deep.join(plan.select(F.col("dest").alias("path")), "path", "left_anti").select("path").distinct()


def copies_needed(plan: DataFrame, sources: DataFrame, present: DataFrame) -> DataFrame:
    """(dest, src, action): copy, skip (there with the same size) or missing; the others list (path, length)."""
    have = sources.select(F.col("path").alias("src"), F.col("length").alias("_src_size"))
    there = present.select(F.col("path").alias("dest"), F.col("length").alias("_dest_size"))
    met = plan.join(have, "src", "left").join(there, "dest", "left")
    action = F.when(F.col("_src_size").isNull(), "missing").when(F.col("_src_size") == F.col("_dest_size"), "skip").otherwise("copy")
    return met.select("dest", "src", action.alias("action"))


def run_copies(todo: DataFrame, root: str) -> DataFrame:
    """Copy the files of ``todo`` (dest, src, action) whose action is copy below ``root``, on the executors; returns
    (dest, copied).  Both ends have to be on a file system that all of them mount."""
    ship(todo.sparkSession)

    def run(frames):
        for frame in frames:
            for dest, src in zip(frame["dest"], frame["src"], strict=True):
                target = Path(root, dest)
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f"{target.name}.{os.getpid()}.part")
                shutil.copy2(src, part)
                os.replace(part, target)
            yield frame[["dest"]].assign(copied=True)

    return todo.where("action = 'copy'").select("dest", "src").mapInPandas(run, "dest string, copied boolean")


def prune(stale: DataFrame, root: str) -> int:
    """Delete stale files below ``root`` and the folders that they leave empty; returns how many files went."""
    n = 0
    for row in stale.toLocalIterator():
        Path(root, row["path"]).unlink(missing_ok=True)
        n += 1
    for folder, _, _ in os.walk(root, topdown=False):
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)
    return n


def songbook(tracks: DataFrame) -> DataFrame:
    """(artist, song, details, position): distinct pairs of named artists in their commonest spellings, sorted without
    accents and case.  Details are those of the best copy."""
    rows = with_meta(tracks, "mp3_size", "length_seconds", "bitrate_bps", "tag_year", "tag_album")
    rows = rows.where(~X.is_unknown(F.coalesce("artist", F.lit("")))).withColumns({"_a": X.book_display("artist"), "_s": X.book_display("song")})
    rows = rows.withColumns({"artist_key": X.clean_artist("_a"), "song_key": X.clean_song("_s")}).where("artist_key <> '' and song_key <> ''")
    order = F.struct((-X.whole("mp3_size")).alias("s"), groups.title_order().alias("t"), F.col("ord").alias("o"))
    album = F.when(meta(rows, "tag_album") != "<not-found>", F.col("tag_album"))
    best = rows.groupBy("artist_key", "song_key").agg(F.min_by(X.book_details("length_seconds", "bitrate_bps", "tag_year", album), order).alias("details"), F.min("ord").alias("_o"))
    artists = groups.majority(rows, ["artist_key"], "_a").select("artist_key", F.col("_a").alias("artist"))
    songs = groups.majority(rows, ["artist_key", "song_key"], "_s").select("artist_key", "song_key", F.col("_s").alias("song"))
    return best.join(songs, ["artist_key", "song_key"]).join(artists, "artist_key").select("artist", "song", "details", fold("artist").alias("artist_sort"), fold("song").alias("song_sort"), F.col("_o").alias("first_ord"))


def search_form(x: Column | str) -> Column:
    return F.trim(X.sub(X.sub(F.lower(to_ascii(x)), "[^a-z0-9 ]+", " "), " +", " "))


def songbook_search(book: DataFrame, text: str, within: str = "all", letter: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(artist, song, total): rows of the songbook that have all words of ``text`` in artist, song or both, the first
    ``limit`` in the book's order, with the number of all."""
    rows = book.withColumns({"_a": search_form("artist"), "_s": search_form("song")})
    hay = F.col("_a") if within == "artist" else F.col("_s") if within == "song" else F.concat_ws(" ", "_a", "_s")
    wanted = F.filter(F.split(search_form(F.lit(text)), " "), lambda w: w != "")
    found = rows.where(F.forall(wanted, lambda w: F.contains(hay, w)))
    if letter:
        first = F.substring("_a", 1, 1)
        found = found.where(F.when(first.rlike("^[a-z]"), F.upper(first)).otherwise("#") == letter)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    first = found.orderBy("artist_sort", "song_sort", "first_ord").limit(limit)
    return first.select("artist", "song", total.scalar().alias("total"))


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>__TITLE__</title></head>
<body><h1>__TITLE__</h1><p>__COUNT__ songs</p>
<form id="ask">
<input name="text" type="search" placeholder="Search">
<select name="within"><option value="all">All</option><option value="artist">Artist</option><option value="song">Song title</option></select>
<select name="letter"><option value="">A-Z</option></select>
</form>
<p id="total"></p><div id="rows"></div>
<script id="data" type="application/json">__DATA__</script>
<script>
const plain = t => t.normalize("NFKD").replace(/[^\\x00-\\x7f]/g, "").toLowerCase().replace(/[^a-z0-9]+/g, " ").trim();
const first = key => /^[a-z]/.test(key) ? key[0].toUpperCase() : "#";
const rows = JSON.parse(document.getElementById("data").textContent).map(line => {
  const [artist, song, details] = line.split("\\t"), keys = {artist: plain(artist), song: plain(song)};
  return {artist, song, details, keys: {...keys, all: keys.artist + " " + keys.song}, letter: first(keys.artist)};
});
const ask = document.getElementById("ask"), {text, within, letter} = ask.elements;
for (const l of [...new Set(rows.map(r => r.letter))].sort()) letter.add(new Option(l));
const line = r => Object.assign(document.createElement("div"), {
  textContent: r.artist + " – " + r.song, title: r.details,
  onclick: () => { text.value = r.artist; within.value = "artist"; letter.value = ""; show(); },
});
const show = () => {
  const want = plain(text.value).split(" ");
  const hits = rows.filter(r => (!letter.value || r.letter === letter.value) && want.every(w => r.keys[within.value].includes(w)));
  document.getElementById("total").textContent = hits.length > __LIMIT__ ? `first __LIMIT__ of ${hits.length}` : `${hits.length}`;
  document.getElementById("rows").replaceChildren(...hits.slice(0, __LIMIT__).map(line));
};
ask.oninput = show; ask.onsubmit = () => false; show();
</script></body></html>
"""


def songbook_lines(book: DataFrame) -> DataFrame:
    """(line): rows of the page, tabs inside fields as spaces, in the book's order."""
    flat = [F.translate(F.col(c), "\t", " ") for c in ("artist", "song", "details")]
    return book.orderBy("artist_sort", "song_sort", "first_ord").select(F.concat_ws("\t", *flat).alias("line"))


def write_songbook(book: DataFrame, target: str, name: str = "") -> int:
    """Write the book as one searchable HTML page; the page holds all rows, so they come to the driver."""
    lines = [r["line"] for r in songbook_lines(book).toLocalIterator()]
    title = html.escape(f"{name}'s {BOOK_TITLE}" if name else BOOK_TITLE, quote=False)
    data = json.dumps(lines, ensure_ascii=False).replace("</", "<\\/")
    page = PAGE.replace("__TITLE__", title).replace("__COUNT__", f"{len(lines):,}").replace("__LIMIT__", str(SEARCH_LIMIT)).replace("__DATA__", data)
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    Path(target).write_text(page, encoding="utf-8")
    return len(lines)


def write_index(index: DataFrame, target: str) -> int:
    """Write ``index.json`` row by row, by way of a temporary file."""
    part, n = Path(f"{target}.tmp"), 0
    part.parent.mkdir(parents=True, exist_ok=True)
    with part.open("w", encoding="utf-8") as out:
        out.write('{"version": 1, "songs": [')
        for row in index_json(index).orderBy("path").toLocalIterator():
            out.write((", " if n else "") + row["json"])
            n += 1
        out.write("]}")
    os.replace(part, target)
    return n
