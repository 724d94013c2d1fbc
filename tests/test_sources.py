import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.sources import files, store
from recordloom.streaming import ingest

from .helpers import tracks


def tag(name, text):
    body = b"\x03" + text.encode()
    return name.encode() + struct.pack(">I", len(body))[0:4] + b"\0\0" + body


def mp3(tags=(), frames=20):
    own = b"".join(tag(n, t) for n, t in tags)
    head = b"ID3\x03\0\0" + bytes([(len(own) >> s) & 127 for s in (21, 14, 7, 0)]) + own if tags else b""
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + b"\0" * (144 * 128000 // 44100 - 4)
    return head + frame * frames


def test_mp3_fields():
    data = mp3([("TPE1", " Pete "), ("TIT2", "Song"), ("TYER", "1999"), ("TKEY", "Am"), ("TXXX", "no")])
    info = files.mp3_info(data)
    assert info["bitrate_bps"] == "128000" and info["sample_rate_hz"] == "44100" and info["channels"] == "2" and abs(float(info["length_seconds"]) - 20 * 417 * 8 / 128000) < 0.02
    assert files.mp3_tags(data) == {"tag_artist": "Pete", "tag_title": "Song", "tag_album": "<not-found>", "tag_year": "1999", "tag_genre": "<not-found>", "tag_key": "Am"}
    assert files.mp3_info(b"nothing") == {} and set(files.mp3_tags(b"").values()) == {"<not-found>"}


def library(root):
    (root / "A").mkdir()
    (root / "song-artist").mkdir()
    sound = mp3([("TPE1", "Tagged")])
    with zipfile.ZipFile(root / "A/X - Artist - Song.zip", "w") as z:
        z.writestr("in/one.mp3", sound)
        z.writestr("in/one.CDG", b"picture")
    (root / "A/Name - Title - SF 193-16.cdg").write_bytes(b"123456789")
    (root / "A/Name - Title - SF 193-16.mp3").write_bytes(sound)
    (root / "A/lonely.CDG").write_bytes(b"1")
    (root / "A/only.mp3").write_bytes(sound)
    (root / "song-artist/Y - Left - Right.zip").write_bytes(b"torn")
    (root / "notes.txt").write_text("x")
    return sound


def test_scan_and_details(spark, tmp_path):
    sound = library(tmp_path)
    listing = files.list_files(spark, str(tmp_path))
    rows = {r["path"].rpartition("/")[2]: r for r in files.scan(listing).collect()}
    assert {k: (r["artist"], r["song"], r["file_types"]) for k, r in rows.items()} == {
        "X - Artist - Song.zip": ("Artist", "Song", ["zip"]), "Name - Title - SF 193-16.cdg": ("Name", "Title", ["mp3", "cdg"]),
        "lonely.CDG": ("Unknown", "lonely", ["cdg"]), "Y - Left - Right.zip": ("Right", "Left", ["zip"]),
    }
    found = files.scan(listing).withColumn("ord", F.monotonically_increasing_id())
    assert files.scan(listing, found).count() == 0
    changed = files.changed_files(found, listing)
    assert changed.count() == 4
    detailed = files.with_details(found, files.read_details(spark, str(tmp_path)), changed)
    rows = {r["path"].rpartition("/")[2]: r for r in detailed.collect()}
    assert rows["X - Artist - Song.zip"]["mp3_size"] == str(len(sound)) and rows["X - Artist - Song.zip"]["cdg_hash"] == f"{zlib.crc32(b'picture'):08x}"
    assert rows["Name - Title - SF 193-16.cdg"]["cdg_hash"] == "cbf43926" and rows["Name - Title - SF 193-16.cdg"]["tag_artist"] == "Tagged"
    assert rows["Y - Left - Right.zip"]["error"].startswith("bad zip")
    assert files.changed_files(detailed, listing).count() == 0


def test_member_with_a_wrong_checksum(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.mp3", b"payload")
        z.writestr("a.cdg", b"x")
    data = path.read_bytes()
    broken = data.replace(b"payload", b"paylaod", 1)
    assert files.zip_details(broken)["mp3_size"] == "7" and files.zip_sound(broken) == b"paylaod"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.mp3", b"payload")
    assert files.zip_details(path.read_bytes()) == {} and files.zip_sound(b"") is None


def test_track_file(spark, tmp_path):
    path = str(tmp_path / "deep/store.json")
    assert store.load_tracks(spark, path).count() == 0
    data = {"version": 1, "tracks": [{"path": "a"}, {"path": "b", "file_types": ["zip"], "artist": "B", "song": "s", "metadata": {"length_seconds": "180", "tag_artist": "<not-found>"}}, {"path": "a", "artist": "Last"}]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/store.json").write_text(json.dumps(data))
    rows = {r["path"]: r for r in store.load_tracks(spark, path).collect()}
    assert rows["a"]["artist"] == "Last" and rows["a"]["song"] == "" and rows["a"]["file_types"] == [] and rows["a"]["ord"] == 0
    assert rows["b"]["length_seconds"] == "180" and rows["b"]["tag_artist"] is None
    store.save_tracks(store.load_tracks(spark, path), str(tmp_path / "again.json"))
    again = json.loads((tmp_path / "again.json").read_text())
    assert [t["path"] for t in again["tracks"]] == ["a", "b"] and again["tracks"][1]["metadata"] == {"length_seconds": "180"}
    (tmp_path / "deep/store.json").write_text(json.dumps({"version": 99, "tracks": []}))
    with pytest.raises(ValueError, match="99"):
        store.load_tracks(spark, path)


def test_review_and_side_files(spark, tmp_path):
    path = str(tmp_path / "review.json")
    assert store.load_review(spark, path).count() == 0
    store.save_review(spark.createDataFrame([("a", "ok"), ("b", "swap")], store.REVIEW), path)
    assert {tuple(r) for r in store.load_review(spark, path).collect()} == {("a", "ok"), ("b", "swap")}
    (tmp_path / "review.json").write_text('{"version": 99}')
    with pytest.raises(ValueError):
        store.load_review(spark, path)
    (tmp_path / "bare.json").write_text('{"a": "Am"}')
    (tmp_path / "full.json").write_text('{"version": 1, "overrides": {"a": "Am", "n": 1}}')
    for name in ("bare.json", "full.json"):
        assert [tuple(r) for r in store.load_mapping(spark, str(tmp_path / name), "overrides", ("name", "key")).collect()] == [("a", "Am")]
    assert store.load_mapping(spark, str(tmp_path / "none.json"), "overrides", ("name", "key")).count() == 0
    (tmp_path / "res.json").write_text('{"resolutions": {"p": {"artist": "A", "why": "w"}}}')
    assert [tuple(r) for r in store.load_resolutions(spark, str(tmp_path / "res.json")).collect()] == [("p", "A", None, "w")]
    store.save_config({"version_limit": 2}, str(tmp_path / "c.json"))
    assert store.load_config(str(tmp_path / "c.json")) == {"version_limit": 2} and store.load_config(str(tmp_path / "x.json")) == {}


def test_upsert_keeps_the_first_place(spark):
    old = tracks(spark, [("a", "A", "s"), ("b", "B", "s")], "").drop("file_types")
    new = spark.createDataFrame([(10, "a", "A2", "s"), (11, "a", "A3", "s"), (12, "c", "C", "s")], "ord long, path string, artist string, song string")
    assert sorted(tuple(r) for r in store.upsert(old, new).select("path", "artist", "ord").collect()) == [("a", "A3", 0), ("b", "B", 1), ("c", "C", 12)]


def test_snapshots_and_stream(spark, tmp_path):
    snapshots = store.Snapshots(spark, str(tmp_path / "table"))
    assert snapshots.read() is None
    listings = tmp_path / "listings"
    listings.mkdir()

    def take(name, paths):
        rows = [json.dumps({"path": p, "length": 1, "modificationTime": "2024-01-01T00:00:00Z"}) for p in paths]
        (listings / name).write_text("\n".join(rows))
        ingest.follow(spark, str(listings), str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()

    take("1.json", ["/l/X - A - S.zip", "/l/x.txt"])
    take("2.json", ["/l/X - A - S.zip", "/l/Y - B - T.zip"])
    got = snapshots.read()
    assert sorted((r["path"], r["artist"]) for r in got.collect()) == [("/l/X - A - S.zip", "A"), ("/l/Y - B - T.zip", "B")]
    assert [r["artist"] for r in got.orderBy("ord").collect()] == ["A", "B"]


def test_a_crash_between_the_steps_of_a_commit_leaves_the_last_snapshot(spark, tmp_path, monkeypatch):
    snapshots = store.Snapshots(spark, str(tmp_path / "table"))
    snapshots.commit(spark.range(3))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store.Snapshots, "_move", stop)
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(spark.range(5))
    assert store.Snapshots(spark, str(tmp_path / "table")).read().count() == 3
    for n in range(6, 11):
        snapshots.commit(spark.range(n))
    assert snapshots.read().count() == 10
    assert len(snapshots._pointers()) == store.Snapshots.KEEP


def test_order_of_arrival_over_many_partitions(spark):
    listing = lambda a, b: spark.range(a, b, 1, 200).selectExpr("concat('/k/A - S', id, '.zip') as path", "1L as length", "current_timestamp() as modificationTime")
    first = ingest.merge_listing(None, listing(0, 400))
    rows = ingest.merge_listing(first, listing(300, 700))
    top = first.agg({"ord": "max"}).first()[0]
    assert rows.select("ord").distinct().count() == rows.count() == 700
    assert rows.where(f"ord <= {top}").count() == 400
