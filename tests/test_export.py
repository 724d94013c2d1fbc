import json
from pathlib import Path

from recordloom.plans import export

from .helpers import tracks

EXTRA = "mp3_size string, length_seconds string, key string, key_confidence string, key_source string"


def library(spark):
    return tracks(spark, [
        ("lib/SC/a.zip", "AC/DC", "Hells Bells", "9", "200.7", "A minor", "0.9", "auto"), ("lib/SF/b.zip", "ac/dc", "Hells Bells", "5", "190", None, None, None),
        ("lib/SF/a.zip", "AC/DC", "Hells Bells", "4", None, None, None, None), ("lib/SC/c.zip", "Unknown", "x", "9", None, None, None, None), ("lib/SC/d.zip", "2 Live", "</script>", "9", "bad", None, None, None),
    ], EXTRA)


def test_plan(spark):
    one = {r["dest"]: r["src"] for r in export.export_plan(library(spark)).collect()}
    assert one == {"a/ac-dc/a.zip": "lib/SC/a.zip", "#/2 live/d.zip": "lib/SC/d.zip"}
    three = {r["dest"]: r["src"] for r in export.export_plan(library(spark), 3).collect()}
    assert three == one | {"a/ac-dc/b.zip": "lib/SF/b.zip"}  # the third copy has the first one's name


def test_index(spark, tmp_path):
    n = export.write_index(export.export_index(library(spark), 3), str(tmp_path / "out/index.json"))
    data = json.loads((tmp_path / "out/index.json").read_text())
    assert n == 2 and data["version"] == 1
    assert data["songs"][1] == {"path": "a/ac-dc/a.zip", "artist": "AC/DC", "title": "Hells Bells", "duration": 200, "key": "A minor", "key_confidence": 0.9, "key_source": "auto", "versions": [{"path": "a/ac-dc/b.zip", "label": "SF", "duration": 190}]}
    assert data["songs"][0] == {"path": "#/2 live/d.zip", "artist": "2 Live", "title": "</script>", "duration": 0}


def test_copies_and_prune(spark, tmp_path):
    source, root = tmp_path / "lib", tmp_path / "out"
    source.mkdir()
    (source / "a.zip").write_bytes(b"12345")
    (source / "b.zip").write_bytes(b"123")
    plan = spark.createDataFrame([("x/y/a.zip", str(source / "a.zip")), ("x/y/b.zip", str(source / "b.zip")), ("x/y/c.zip", str(source / "c.zip"))], "dest string, src string")
    sources = spark.createDataFrame([(str(source / "a.zip"), 5), (str(source / "b.zip"), 3)], "path string, length long")
    present = spark.createDataFrame([("x/y/b.zip", 3), ("x/y/old.zip", 1), ("top.zip", 1)], "path string, length long")
    todo = export.copies_needed(plan, sources, present)
    assert {r["dest"]: r["action"] for r in todo.collect()} == {"x/y/a.zip": "copy", "x/y/b.zip": "skip", "x/y/c.zip": "missing"}
    assert [r["dest"] for r in export.run_copies(todo, str(root)).collect()] == ["x/y/a.zip"]
    assert (root / "x/y/a.zip").read_bytes() == b"12345"
    (root / "q/r").mkdir(parents=True)
    (root / "q/r/old.zip").write_bytes(b"1")
    stale = export.stale_files(spark.createDataFrame([("q/r/old.zip",), ("x/y/a.zip",), ("top.zip",)], "path string"), plan)
    assert export.prune(stale, str(root)) == 1 and not (root / "q").exists() and (root / "x/y/a.zip").exists()


def test_songbook(spark, tmp_path):
    df = tracks(spark, [("a", "Élan", "B", "1"), ("b", "elan", "b (Wbgv)", "2"), ("c", "Élan", "b", None), ("d", "Zed", "A\tB", None), ("e", "Unknown", "x", None)])
    book = export.songbook(df)
    assert [(r["artist"], r["song"]) for r in book.orderBy("artist_sort", "song_sort", "first_ord").collect()] == [("Élan", "B"), ("elan", "b"), ("Zed", "A\tB")]
    assert export.write_songbook(book, str(tmp_path / "book.html"), "A & B") == 3
    page = Path(tmp_path / "book.html").read_text()
    assert "<title>A &amp; B's Karaoke Songbook</title>" in page and "A B" in page
    rows = export.songbook_search(book, "  ÉLAN b", limit=1).collect()
    assert [(r["artist"], r["total"]) for r in rows] == [("Élan", 2)]
    assert export.songbook_search(book, "", letter="Z").count() == 1
    assert export.songbook_search(book, "zed", within="song").count() == 0


def test_markup_in_titles_is_escaped(spark, tmp_path):
    export.write_songbook(export.songbook(library(spark)), str(tmp_path / "b.html"))
    assert "<\\/script>" in (tmp_path / "b.html").read_text()
