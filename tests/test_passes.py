from pyspark.sql import functions as F

from recordloom.operators import groups, stats
from recordloom.plans import cleanup, corroborate, review

from .helpers import names, tracks

STATE = "path string, status string"


def many(artist, n, song="S", start=0):
    return [(f"lib/{artist}/{i}.zip", artist, f"{song}{i}", None) for i in range(start, start + n)]


def test_majority_spelling(spark):
    df = tracks(spark, [("a", "tom jones", "x", None), ("b", "Tom Jones", "x", None), ("c", "TOM JONES", "x", None), ("d", "Tom Jones", "x", None), ("e", "", "x", None)])
    assert [tuple(r) for r in groups.majority(groups.keyed(df), ["artist_key"], "artist").collect()] == [("tom jones", "Tom Jones", 2)]
    tie = tracks(spark, [("a", "B B", "x", None), ("b", "b b", "x", None)])
    assert groups.majority(groups.keyed(tie), ["artist_key"], "artist").first()["artist"] == "B B"


def test_best_copy_ties(spark):
    df = tracks(spark, [("a", "X", "s", "5"), ("b", "X", "s", "9"), ("c", "x", "s", "9"), ("d", "X", "s", "bad")])
    assert [r["path"] for r in groups.best_copy(df).collect()] == ["b"]
    assert [(r["path"], r["rank"]) for r in groups.ranked_versions(df, 3).orderBy("rank").collect()] == [("b", 1), ("c", 2), ("a", 3)]


def test_known_and_thin(spark):
    df = tracks(spark, many("Big", 6) + many("Unknown", 3) + [("e1", "", "x", None), ("e2", "", "y", None)])
    assert {r["artist_key"] for r in groups.known_artists(df, 2).collect()} == {"big", "unknown"}
    assert {r["artist_key"] for r in groups.thin_artists(df).collect()} == {"unknown", ""}


def test_empty_library(spark):
    df = tracks(spark, [])
    row = stats.library_totals(df).first()
    assert (row["files"], row["distinct_songs"], row["bytes"], row["avg_seconds"]) == (0, 0, 0, None)
    assert stats.distinct_pairs(df).first()["pairs"] == 0
    assert cleanup.all_clean(df).count() == 0


def test_report(spark):
    assert stats.report(tracks(spark, [])) == ["The library is empty."]
    df = tracks(spark, many("Big", 2) + [("x", "Big", "S0", "2000000")]).withColumn("length_seconds", F.lit("65.9")).withColumn("tag_year", F.lit("1987"))
    lines = stats.report(df)
    assert "Extra copies: 1 (33% of files)" in lines and "Mean length: 1m 5s" in lines and "1980s: 3" in lines and "   2 copies of Big - S0" in lines and "   1. Big: 2 songs" in lines


def test_clean(spark):
    df = tracks(spark, [
        ("a/1.zip", "Foo (Wbgv)", "Bar (Duet) Multiplex", None), ("a/2.zip", "Foo", "Bar [SC Karaoke] Baz", None), ("a/3.zip", "Foo (WOBGV)", "Bar", None),
        ("a/EZH-31 - 04 - Milkshake.zip", "04", "Milkshake", None), ("a/5.zip", "SC\\SC-199", "X", None), ("a/6.zip", " ", "Y", None),
        ("a/7.zip", "Chris Isaak", "Isaak, Chris-Wicked Game", None), ("a/Real - Title - SF 193-16.zip", "Title", "SF 193-16", None), ("a/LeVert - ABC 123.zip", "LeVert", "ABC 123", None),
    ])
    out = cleanup.clean(df).orderBy("ord").collect()
    assert [(r["artist"], r["song"]) for r in out] == [
        ("Foo", "Bar"), ("Foo", "Bar Baz"), ("Foo", "Bar"), ("Unknown", "Milkshake"), ("Unknown", "X"), ("Unknown", "Y"), ("Chris Isaak", "Wicked Game"), ("Real", "Title"), ("LeVert", "ABC 123"),
    ]
    assert [r["style"] for r in out][:3] == ["Multiplex", "[SC Karaoke]", "(WOBGV)"]
    assert (out[3]["track_no"], out[3]["catalog_id"], out[4]["catalog_id"], out[7]["catalog_id"]) == ("04", "EZH-31", "SC\\SC-199", "SF 193-16")


def test_tag_fill(spark):
    rows = [("a", "Unknown", "x", "Zac Band (Wbgv)"), ("b", "", "x", "311"), ("c", None, "x", "PS1254"), ("d", "Real", "x", "Other"), ("e", "Unknown", "x", "<not-found>"), ("f", "Unknown", "x", None)]
    out = cleanup.fill_from_tags(tracks(spark, rows, "tag_artist string")).orderBy("ord").collect()
    assert [(r["artist"], r["artist_from"], r["artist_review_reason"]) for r in out] == [("Zac Band", "tag", None), ("", None, "numeric"), ("", None, "catalog-id"), ("Real", None, None), ("Unknown", None, None), ("Unknown", None, None)]


def test_uncomma_and_aliases(spark):
    df = tracks(spark, many("Pete Murray", 2) + [("x", "Murray, Pete", "s", None), ("y", "Jones, Tom", "s", None), ("z", "Nobody, New", "s", None)])
    aliases = spark.createDataFrame([("Jones, Tom", "Tom Jones"), ("same", "same"), ("", "x"), ("q", None)], "variant string, canonical string")
    assert [a for a, _ in names(cleanup.uncomma_artists(df, aliases))][-3:] == ["Pete Murray", "Tom Jones", "Nobody, New"]
    assert [a for a, _ in names(cleanup.apply_aliases(df, aliases))][-3:] == ["Murray, Pete", "Tom Jones", "Nobody, New"]


def test_ungroup(spark):
    rows = many("Pete Murray", 2) + [("x1", "Pete Murray & Friends", "s", None), ("x2", "Pete Murray & Friends", "s", None), ("y", "No One & Friends", "s", None)]
    out = cleanup.ungroup_artists(tracks(spark, rows)).orderBy("ord").collect()
    assert [(r["artist"], r["feature"]) for r in out][2:] == [("Pete Murray", "Friends"), ("Pete Murray & Friends", None), ("No One & Friends", None)]
    both = cleanup.ungroup_artists(tracks(spark, rows), all_copies=True).orderBy("ord").collect()
    assert [r["artist"] for r in both][2:4] == ["Pete Murray"] * 2


def test_fuzzy_merges(spark):
    df = tracks(spark, many("Pete Murray", 7) + [("x", "Pete Muray", "s", None)])
    assert names(cleanup.merge_similar_artists(df))[-1] == ("Pete Murray", "s")
    songs = tracks(spark, [("a", "X", "Wicked Game", None), ("b", "X", "Wicked Game", None), ("c", "X", "Wicked Gamee", None), ("d", "Y", "Wicked Gamee", None)])
    assert [s for _, s in names(cleanup.merge_similar_songs(songs))] == ["Wicked Game"] * 3 + ["Wicked Gamee"]


def test_unswap(spark):
    rows = many("Star", 4) + [(f"d/{i}.zip", f"Title {i}", "Star", None) for i in range(4)] + [("e/1.zip", "Title 9", "Star", None)]
    got = names(cleanup.unswap(tracks(spark, rows)))
    assert got[4:8] == [("Star", f"Title {i}") for i in range(4)] and got[8] == ("Title 9", "Star")


def test_refresh(spark):
    rows = many("Star", 6) + [("d/Hit - Star.zip", "x", "y", None), ("d/Star_&_Friends - Hit.zip", "x", "y", None), ("d/A - B.zip", "x", "y", None), ("d/DIS61201-13-FOO-BAR.zip", "Unknown", "y", None), ("d/a - b - c.zip", "Unknown", "y", None)]
    assert names(cleanup.refresh_names(tracks(spark, rows)))[6:] == [("Star", "Hit"), ("x", "y"), ("x", "y"), ("FOO", "BAR"), ("Unknown", "y")]


def test_fix_unknown(spark):
    songs = ["Star - Hit", "ID - Star - Hit", "a - b - Star - Hit", "Star-Hit", "x-Star-Hit", "Hit  Star", "Star  Hit", "Star, Hit", "Star Hit", "No - Hit", "a - b - c - Star - Hit"]
    got = names(cleanup.fix_unknown(tracks(spark, many("Star", 6) + [(f"p{i}", "Unknown", s, None) for i, s in enumerate(songs)])))[6:]
    assert got == [("Star", "Hit")] * 8 + [("Unknown", s) for s in songs[8:]]


def test_review_queue_and_tags(spark):
    rows = [(p, a, s, t) for p, a, s, t in [
        ("a", "Murray, Pete", "x", "Pete Murray"), ("b", "Pete Other", "x", "Someone"), ("c", "Done", "x", "Done"), ("d", "Hit", "Star", "Hit"), ("e", "Thin", "x", "<not-found>"),
    ]] + [(f"s{i}", "Star", f"t{i}", None) for i in range(6)]
    df, state = tracks(spark, rows, "tag_artist string"), spark.createDataFrame([("c", "ok"), ("b", "skip")], STATE)
    assert {r["path"] for r in review.review_queue(df, state).collect()} == {"a", "b", "d", "e"}
    always = spark.createDataFrame([("STAR",)], "artist string")
    assert review.review_queue(df, state, always).count() == 10
    assert {r["path"] for r in review.settle_by_tags(df, state).collect()} == {"a"}
    assert {(r["path"], r["status"]) for r in review.mark(state, df.where("path = 'b'")).collect()} == {("c", "ok"), ("b", "ok")}


def test_tag_swap(spark):
    rows = [("a", "Hit", "Star", "Star"), ("b", "Hut", "Star", "Hut"), ("c", "Hat", "Murray, Pete", None), ("d", "Hot", "Star", None), ("e", "Pete Murray", "Star", "Star")]
    rows += [(f"s{i}", "Star", f"t{i}", None) for i in range(4)] + [(f"m{i}", "Pete Murray", f"t{i}", None) for i in range(4)]
    out, settled = review.swap_by_tags(tracks(spark, rows, "tag_artist string"))
    assert names(out)[:5] == [("Star", "Hit"), ("Hut", "Star"), ("Pete Murray", "Hat"), ("Hot", "Star"), ("Pete Murray", "Star")]
    assert {r["path"] for r in settled.collect()} == {"a", "c"}


def test_resolutions(spark):
    df, state = tracks(spark, [("a", "A", "s", None), ("b", "B", "t", None), ("c", "C", "u", None)]), spark.createDataFrame([("c", "ok")], STATE)
    given = spark.createDataFrame([("a", "New", None), ("c", "C", None), ("z", "Z", None)], "path string, artist string, song string")
    out, settled = review.apply_resolutions(df, state, given)
    assert [(r["artist"], r["artist_from"]) for r in out.orderBy("ord").collect()] == [("New", "resolutions"), ("B", None), ("C", None)]
    assert [r["path"] for r in settled.collect()] == ["a"]
    assert {r["path"]: r["outcome"] for r in review.resolution_report(df, state, given).collect()} == {"a": "apply", "c": "unchanged", "z": "missing"}


def test_edits(spark):
    df = tracks(spark, [("a", "A", "s", None), ("b", "B & Q", "t", None), ("c", "C", "u", None), ("d", "D", "v", None)]).withColumn("mb_artist", F.lit("Dee")).withColumn("mb_title", F.lit("V!"))
    edits = spark.createDataFrame([("a", "swap", None, 1), ("a", "artist", "Z", 2), ("b", "auto-clean", None, 1), ("c", "unset-artist", None, 1), ("c", "song", "", 2), ("d", "accept", None, 1)], "path string, op string, value string, ts int")
    out = review.apply_edits(df, edits).orderBy("ord").collect()
    assert [(r["artist"], r["song"], r["feature"]) for r in out] == [("Z", "A", None), ("B", "t", "Q"), ("", "u", None), ("Dee", "v", None)]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "shape string, query_artist string, query_title string, rank int, artist string, title string")


def test_corroborate(spark):
    df, state = tracks(spark, [("a", "Pete Murray", "So Beautiful", None), ("b", "Hit Song", "Some Star", None), ("c", "Albums", "Tune Here", None), ("d", "Nope", "Nothing", None), ("e", "Close Enough", "Other Words", None), ("f", "By Title", "Long Title", None)]), spark.createDataFrame([], STATE)
    found = candidates(spark, [
        ("direct", "pete murray", "so beautiful", 0, "Murray, Pete", "So Beautiful"), ("direct", "some star", "hit song", 0, "Some Star", "Hit Song"), ("release", "albums", "tune here", 1, "Real One", "Tune Here"),
        ("direct", "close enough", "other words", 0, "Close Enouhg X", "Other Wards"), ("title", "", "long title", 0, "By Titel", "Long Title"), ("title", "", "long title", 1, "By Title", "Long Title"),
    ])
    assert corroborate.queries_for(df).count() > 0
    out, settled = corroborate.corroborate(df, state, found)
    rows = {r["path"]: r for r in out.collect()}
    assert {p: r["mb_match"] for p, r in rows.items()} == {"a": "ok", "b": "swap", "c": "suggest", "d": "none", "e": "flag", "f": "title"}
    assert (rows["b"]["artist"], rows["b"]["song"]) == ("Some Star", "Hit Song") and rows["c"]["mb_artist"] == "Real One"
    assert {r["path"] for r in settled.collect()} == {"a", "b", "f"}
    assert corroborate.corroborate(out, state, found)[1].count() == 0  # looked up already


def test_restitch(spark):
    rows = many("Belinda Carlisle", 2) + [("d/FLY-03-06 - Belinda - Carlisle - Heaven Is A Pla - On Earth.zip", "Belinda", "Carlisle", None), ("d/X - Y - Z.zip", "X", "Y", None)]
    df, state = tracks(spark, rows), spark.createDataFrame([], STATE)
    asked = corroborate.restitch_questions(df, state).collect()
    assert [(r["artist"], r["fragments"], r["words"]) for r in asked] == [("Belinda Carlisle", ["Heaven Is A Pla", "On Earth"], ["Heaven", "Earth"])]
    found = candidates(spark, [("restitch", "belinda carlisle", "heaven earth", 0, "Belinda Carlisle", "Heaven Is a Place on Earth"), ("restitch", "belinda carlisle", "heaven earth", 1, "Belinda Carlisle", "Other")])
    out, settled = corroborate.restitch(df, state, found)
    assert names(out)[2] == ("Belinda Carlisle", "Heaven Is a Place on Earth") and settled.count() == 1
    two = found.unionByName(candidates(spark, [("restitch", "belinda carlisle", "heaven earth", 2, "Belinda Carlisle", "Heaven Is a Place on Earth Live")]))
    assert [r["restitch"] for r in corroborate.restitch(df, state, two)[0].orderBy("ord").collect()][2] == "suggest"


def test_detect_keys(spark):
    from recordloom.functions.keys import TEMPLATES

    rows = [("a", "A", "s", "h1", None, None), ("b", "B", "s", "h2", "h2", "C major"), ("c", "C", "s", "h3", None, None), ("d", "D", "s", "h4", "h4", "C major")]
    df = tracks(spark, rows, "mp3_hash string, key_sig string, key string")
    profiles = spark.createDataFrame([("a", TEMPLATES[1][1])], "path string, profile array<double>")
    overrides = spark.createDataFrame([(" D - S ", "Am")], "name string, key string")
    online = spark.createDataFrame([("c", "s", "Gbm")], "query_artist string, query_title string, key string")
    out = corroborate.detect_keys(df, profiles, overrides, online).orderBy("ord").collect()
    assert [(r["key"], r["key_source"]) for r in out] == [("C minor", "auto"), ("C major", None), ("F# minor", "online"), ("A minor", "manual")]
    assert out[3]["key_confidence"] == "1.000" and out[3]["key_camelot"] == "8A" and out[3]["key_sig"] == "h4"


def test_searches(spark):
    df, state = tracks(spark, [("a", "Chesney, Kenny & Kid", "Tune (Mplx)", None), ("b", "Say \"Hi\"", "x\\y", None), ("c", "", "No Artist", None), ("d", "\"", "Q", None)]), spark.createDataFrame([], STATE)
    found = {(r["shape"], r["query_artist"], r["query_title"]): (r["text"], r["answers"]) for r in corroborate.queries_for(df, state).collect()}
    pair = ("chesney, kenny & kid", "tune (mplx)")
    assert found[("direct", *pair)] == ('artist:"Kenny Chesney & Kid" AND recording:"Tune"', 5)
    assert found[("direct", *pair[::-1])] == ('artist:"Tune" AND recording:"Chesney, Kenny & Kid"', 5)
    assert found[("title", "", pair[1])] == ('recording:"Tune"', 20)
    assert found[("release", *pair)] == ('recording:"Tune" AND release:"Chesney, Kenny & Kid"', 10)
    assert found[("key", *pair)] == ('artist:"Chesney, Kenny & Kid" AND recording:"Tune (Mplx)"', 10)
    assert found[("direct", 'say "hi"', "x\\y")] == ('artist:"Say  Hi" AND recording:"x y"', 5)
    assert not [k for k in found if "no artist" in k] and ("key", '"', "q") not in found


def test_searches_for_titles_in_pieces(spark):
    rows = many("Belinda Carlisle", 2) + [("d/FLY-03-06 - Belinda - Carlisle - Heaven Is A Pla - On Earth.zip", "Belinda", "Carlisle", None), ("d/X - Y - Z.zip", "X", "Y", None)]
    df, state = tracks(spark, rows), spark.createDataFrame([], STATE)
    asked = corroborate.restitch_questions(df, state).where("size(words) > 0").count()
    found = [r for r in corroborate.queries_for(df, state).collect() if r["shape"] == "restitch"]
    assert len(found) == asked > 0
    assert all(r["answers"] == 25 and " AND recording:(" in r["text"] and r["query_title"] == r["text"].split(" AND recording:(")[1].rstrip(")").replace(" AND ", " ").lower() for r in found)
