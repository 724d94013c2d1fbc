import pytest

from recordloom.functions import keys as K

from .helpers import values


def test_every_template_finds_itself(spark):
    got = values(spark, K.profile_to_key("p"), [(v,) for _, v in K.TEMPLATES], "p array<double>")
    assert [r["key"] for r in got] == [n for n, _ in K.TEMPLATES]
    assert all(r["correlation"] == 1.0 and r["confidence"] > 0 for r in got)


def test_flat_and_null_profiles(spark):
    flat, none = values(spark, K.profile_to_key("p"), [([1.0] * 12,), (None,)], "p array<double>")
    assert flat["confidence"] == 0.0 and flat["key"] == "C major" and none is None


def test_other_sizes_raise(spark):
    with pytest.raises(Exception, match="12 values"):
        values(spark, K.profile_to_key("p"), [([1.0] * 11,)], "p array<double>")


def test_spellings(spark):
    cases = {
        "Am": "A minor", "A minor": "A minor", "F#m": "F# minor", "Gbm": "F# minor", "C": "C major", "CM": "C major", "Cm": "C minor", "Bb": "A# major", "8A": "A minor", "8b": "C major",
        "5B": "D# major", "13A": None, "0A": None, "H": None, "": None, "off": None, "Cb": "B major", "B#": "C major", "d min": "D minor", "e MAJOR": "E major", "G foo": None, " a♭m ": "G# minor", None: None,
    }
    assert values(spark, K.normalize_key("a"), list(cases), "a string") == list(cases.values())


def test_wheel(spark):
    names = [f"{n} {m}" for n in K.NAMES for m in ("major", "minor")]
    codes = values(spark, K.to_camelot("a"), names, "a string")
    assert len(set(codes)) == 24 and set(codes) == set(K.WHEEL)
    assert values(spark, K.to_camelot("a"), ["A minor", "C major", "Am", "zz"], "a string") == ["8A", "8B", "8A", None]


def test_fusion(spark):
    rows = [
        (("Am", "C", "D major", 0.9, "E"), ("A minor", 1.0, "manual", "")),
        ((None, "C", "D major", 0.9, None), ("C major", 0.90, "tag", "id3 TKEY")),
        ((None, "C", "C major", 0.1, None), ("C major", 0.97, "tag", "id3 TKEY (corroborated)")),
        ((None, "zz", "C major", 0.7, "C"), ("C major", 0.9, "auto", "offline+online agree")),
        ((None, None, "C major", 0.9, "C"), ("C major", 1.0, "auto", "offline+online agree")),
        ((None, None, "C major", 0.7, "Am"), ("C major", 0.7, "auto", "online disagrees (A minor)")),
        ((None, None, None, None, "Am"), ("A minor", 0.5, "online", "original master key; unverified vs rip")),
        ((None, None, None, None, None), (None, 0.0, "none", "")),
    ]
    got = values(spark, K.combine_key_signals("o", "t", "h", "c", "n"), [r for r, _ in rows], "o string, t string, h string, c double, n string")
    assert [tuple(r) for r in got] == [w for _, w in rows]


def test_emit_and_agree(spark):
    rows = [("manual", 0.0), ("tag", 0.1), ("auto", 0.5), ("auto", 0.49), ("online", 0.5), ("none", 1.0), (None, 1.0)]
    assert values(spark, K.should_emit("s", "c"), rows, "s string, c double") == [True, True, True, False, True, False, False]
    assert values(spark, K.keys_agree("a", "b"), [("Am", "8A"), ("Am", "C"), (None, None)], "a string, b string") == [True, False, False]


def test_index_fields(spark):
    rows = [("A minor", "0.9", "auto", "8A"), ("A minor", "bad", "auto", "8A"), ("A minor", "bad", "tag", ""), (None, "1", "tag", None), ("C major", None, None, None)]
    got = values(spark, K.key_index_fields("k", "c", "s", "w"), rows, "k string, c string, s string, w string")
    assert [r and tuple(r) for r in got] == [("A minor", 0.9, "auto", "8A"), None, ("A minor", 0.0, "tag", None), None, None]
