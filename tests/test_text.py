import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.functions import stems as S
from recordloom.functions import text as X

from .helpers import values

CASES = {
    "clean_artist": (lambda: X.clean_artist("a"), "a string", [
        ("The Beatles", "beatles"), ("Beatles, The", "beatles"), ("A_B feat. C", "a b & c"), ("AC.DC  x", "ac dc x"),
        ("Guns N' Roses and X", "guns n roses & x"), ("", ""), ("Ünï", "ünï"), (None, None),
    ]),
    "clean_song": (lambda: X.clean_song("a"), "a string", [
        ("The Song (Duet)", "song"), ("Rockin' Robin", "rocking robin"), ("A Whole World, The", "whole world"),
        ("X [SC Karaoke] Y", "x y"), ("Me & You, A", "me and you"), ("R.E-M (x) y", "rem y"), ("a the b", "b"),
    ]),
    "letter": (lambda: X.letter("a"), "a string", [("abc", "a"), ("1x", "#"), ("", ""), ("é", "#")]),
    "uncomma": (lambda: X.uncomma_artist("a"), "a string", [
        ("Davis, Sammy Jr.", "Sammy Davis Jr."), ("Murray, Pete", "Pete Murray"), ("Earth, Wind & Fire", None), ("A, B, C", None),
        ("Murray,", None), (", Pete", None), ("Doe, John Ft. Jane Roe", None), ("Beatles, The", None), ("One Two Three Four, X", None), ("Plain", None),
        ("King, Ben II", "Ben King II"),
    ]),
    "safe_folder": (lambda: X.safe_folder("a"), "a string", [("ac/dc", "ac-dc"), ("///", "---"), (" ", "_"), ('a<b>:"c', "a-b---c")]),
    "trailing_article": (lambda: X.fix_trailing_article("a"), "a string", [
        ("Beatles, The", "The Beatles"), ("Whole New World, a", "A Whole New World"), ("Dion, Celine-Power Of Love, The", "Dion, Celine-Power Of Love, The"),
        ("Earth, Wind, The", "Earth, Wind, The"), ("x", "x"), (", The", ", The"),
    ]),
    "book_display": (lambda: X.book_display("a"), "a string", [("Song [SF Karaoke] (Wbgv)", "Song"), ("(I've Had) The Time", "(I've Had) The Time"), (None, "")]),
    "echo": (lambda: X.strip_artist_echo("a", "b"), "a string, b string", [
        (("Chris Isaak", "Isaak, Chris-Wicked Game"), "Wicked Game"), (("Alabama", "My Home's In Alabama"), None), (("X", "Song - X"), "Song"),
        (("", "x-y"), None), (("Q", None), None), (("A", "A-"), None), (("A B", "A-B"), None), (("a", "a-b-a"), "b-a"),
    ]),
    "tokens": (lambda: X.artist_tokens("a"), "a string", [("SFDU11-06 - Murray, Pete (x)", ["murray", "pete"]), ("A & B", ["a", "b"]), ("A And B", ["a", "b"]), (None, [])]),
    "auto_clean": (lambda: X.auto_clean_artist("a")["artist"], "a string", [("Murray, Pete with X", "Pete Murray"), ("A feat. B & C", "A"), ("Plain", "Plain")]),
    "query_form": (lambda: X.query_form("a", uncomma=True), "a string", [
        ("Doe, Jane & Some One", "Jane Doe & Some One"), ("SFDU11-06 - Beatles, The (Wbgv)", "The Beatles"), ("Foo feat. Bar, Baz", "Foo feat. Bar, Baz"), (None, ""),
    ]),
    "catalog": (lambda: S.is_catalog_segment("a"), "a string", [("SF 193-16", True), ("ABC 123", False), ("Blink 182", False), ("EZH-31", True), ("U2", False), ("Old 67", False), ("AB12345", True), (None, False)]),
    "catalog_relaxed": (lambda: S.is_catalog_segment("a", True), "a string", [("SF 193-16", True), ("ABC 123", True), ("Blink 182", False), ("SF 003", True)]),
    "split_stem": (lambda: S.split_stem("a"), "a string", [
        ("SFKK-21-00 - AVRIL - Lavigne - Hot -", ["AVRIL", "Lavigne", "Hot -"]), ("a - SF 003 - 03", ["a"]), ("", []), ("x - SF 193-16", ["x"]),
    ]),
    "fragments": (lambda: S.fragments_match_title("a", "b"), "a array<string>, b string", [
        ((["Bel", "E Again"], "Believe Again"), True), ((["Place"], "Heaven Is A Place"), False), (([], "x"), False), ((["Heaven Is A Pla", "On Earth"], "Heaven Is A Place On Earth"), True),
        ((["a", "b", "a"], "a b"), False), ((["on", "on"], "on on"), True), ((["on", "on"], "on"), False), ((["on"], None), False),
    ]),
    "reliable_words": (lambda: S.reliable_words("a"), "a array<string>", [((["Heaven Is A Pla", "On Earth"],), ["Heaven", "Earth"]), ((["Tur", "E Loose"],), ["Loose"]), ((["aaa bbb ccc", "ddd eee fff", "ggg hhh"],), ["aaa", "bbb", "eee"]), (([],), [])]),
    "stem": (lambda: X.stem("a"), "a string", [("x/y/Foo. Bar.zip", "Foo. Bar"), ("x/.hid", ".hid"), ("a/b.tar.gz", "b.tar"), ("a/b", "b")]),
    "suffix": (lambda: X.with_suffix("a", F.lit("mp3")), "a string", [("x/y.z/Foo.zip", "x/y.z/Foo.mp3"), ("x/b", "x/b.mp3")]),
    "details": (lambda: X.book_details("a", "b", "c", "d"), "a string, b string, c string, d string", [
        (("227.4", "192000", "2007-01", "Album"), "Length: 3:47 @ 192 kbps · 2007 · Album"), (("x", "", "", None), ""), ((None, "128000", "", ""), "128 kbps"), (("60", None, None, "y" * 60), "Length: 1:00 · " + "y" * 48),
    ]),
    "number": (lambda: X.number("a"), "a string", [("12.7", 12), ("bad", 0), (None, 0), ("-3.9", -3)]),
    "whole": (lambda: X.whole("a"), "a string", [("12", 12), ("12.7", 0), ("bad", 0), (None, 0), (" 7 ", 7)]),
    "year": (lambda: X.year("a"), "a string", [("c. 1987", 1987), ("2101", None), (None, None), ("20", None)]),
    "hours": (lambda: X.hours("a"), "a long", [(3600 * 36, "36h (1.5 days)")]),
    "credit": (lambda: X.credit_name("a"), "a array<struct<name:string,artist_name:string,joinphrase:string>>", [(([("A", None, " & "), (None, "B", None)],), "A & B"), ((None,), "")]),
    "phrase": (lambda: X.escape_phrase("a"), "a string", [('a"b\\c', "a b c")]),
    "match_form": (lambda: similarity.match_form("a"), "a string", [("Murray, Pété (x)", "murray pete"), ("The Four Aces", "aces four"), ("Four Aces, The", "aces four"), ("A and B", "a b"), (None, "")]),
}


@pytest.mark.parametrize("name", CASES)
def test_function(spark, name):
    expression, schema, cases = CASES[name]
    rows = [c for c, _ in cases]
    assert values(spark, expression(), rows, schema) == [w for _, w in cases]


def test_parse_stem(spark):
    cases = {
        "Artist - Song - SF 193-16": ("Artist", "Song"), "EZH-31 - 04 - Milkshake": ("04", "Milkshake"), "Artist - Song - SF 003 - 03": ("Artist", "Song"),
        "DIS61201-13-MARY POPPINS-I LOVE TO LAUGH": ("MARY POPPINS", "I LOVE TO LAUGH"), "SF12 - Song": ("", "Song"), "Just": ("", "Just"), "  ": ("", "Unknown"),
        "a - b - c - d": ("b", "c"), "X - ABC 123": ("", "ABC 123"), "DIS61201-13-Foo": ("", "Foo"), "Song - SF 193-16": ("", "Song"), "A - B - C - SF 193-16": ("A", "B - C"),
    }
    got = values(spark, S.parse_artist_song("a"), list(cases), "a string")
    assert [tuple(r) for r in got] == list(cases.values())
