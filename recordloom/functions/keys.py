"""Musical keys: estimation from pitch-class profiles, spelling, and fusion of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, col, strip

# Pitch names, key profiles (Krumhansl and Kessler 1982), the wheel's order and thresholds.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
FULL_MARGIN = 0.12
EMIT_FROM = 0.50
ONLINE_BELOW = 0.85
NOT_A_KEY = ("", "o", "off", "none", "n/a", "na", "-", "unknown", "?")
NATURAL = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

#: Wheel codes: a step round the wheel is a fifth, 8A is A minor and 8B is C major.
WHEEL = {f"{(7 + 7 * pitch) % 12 + 1}B": f"{NAMES[pitch]} major" for pitch in range(12)} | {f"{(7 + 7 * (pitch - 9)) % 12 + 1}A": f"{NAMES[pitch]} minor" for pitch in range(12)}
TEMPLATES = [(f"{NAMES[tonic]} {mode}", [profile[(i - tonic) % 12] for i in range(12)]) for tonic in range(12) for profile, mode in ((MAJOR, "major"), (MINOR, "minor"))]
# What the detail of a key says.
TAG_CORROBORATED, TAG_ALONE = "id3 TKEY (corroborated)", "id3 TKEY"
BOTH_AGREE, ONLINE_DISAGREES = "offline+online agree", "online disagrees ("
ONLINE_ALONE = "original master key; unverified vs rip"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays of one length; 0 where either is flat."""
    n = F.size(x)
    mx, my = _total(x) / n, _total(y) / n
    top = _total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    dx, dy = F.sqrt(_total(F.transform(x, lambda a: (a - mx) * (a - mx)))), F.sqrt(_total(F.transform(y, lambda b: (b - my) * (b - my))))
    return F.when((dx == 0) | (dy == 0), 0.0).otherwise(top / F.nullif(dx * dy, F.lit(0.0)))


def profile_to_key(profile: Column | str) -> Column:
    """struct(key, confidence, correlation, runner_up) of a pitch-class profile from C on; raises unless it has 12.

    The confidence is the margin of the best key to the second, full from 0.12 on; ties go to the lower tonic, major
    first.
    """
    p = col(profile)
    checked = F.when(F.size(p) == 12, p.cast("array<double>")).otherwise(F.raise_error(F.lit("a pitch-class profile has 12 values")).cast("array<double>"))

    def template(k: int) -> Column:
        name, values = TEMPLATES[k]
        own = [v - sum(values) / 12 for v in values]
        return F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(sum(v * v for v in own) ** 0.5).alias("norm"), F.array(*[F.lit(v) for v in own]).alias("own"))

    templates = F.array(*[template(k) for k in range(24)])
    centred = bind(bind(checked, lambda v: F.struct(v.alias("v"), (_total(v) / 12).alias("mean"))), lambda s: F.transform(s["v"], lambda a: a - s["mean"]))
    heard = bind(centred, lambda c: F.struct(c.alias("v"), F.sqrt(_total(F.transform(c, lambda a: a * a))).alias("norm")))

    def rank(h: Column) -> Column:
        def entry(t: Column) -> Column:
            r = F.when(h["norm"] == 0, 0.0).otherwise(_total(F.zip_with(h["v"], t["own"], lambda a, b: a * b)) / F.nullif(h["norm"] * t["norm"], F.lit(0.0)))
            return F.struct((-r).alias("r"), t["k"].alias("k"), t["name"].alias("name"))

        return F.array_sort(F.transform(templates, entry))

    def answer(ranked: Column) -> Column:
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (second["r"] - best["r"]) / FULL_MARGIN))
        return F.struct(best["name"].alias("key"), F.round(confidence, 3).alias("confidence"), F.round(-best["r"], 4).alias("correlation"), second["name"].alias("runner_up"))

    return F.when(p.isNotNull(), bind(bind(heard, rank), answer))


def normalize_key(raw: Column | str) -> Column:
    """'<Tonic> <major|minor>' with sharps, from tags, spelled keys and wheel codes; null for anything else."""
    def read(s: Column) -> Column:
        code = r"^(\p{Nd}{1,2})[\x09-\x0D\x1C-\x20]*([ABab])\z"
        wheel = F.concat(F.regexp_extract(s, code, 1).try_cast("int").cast("string"), F.upper(F.regexp_extract(s, code, 2)))
        spelled = r"^([A-Ga-g])[\x09-\x0D\x1C-\x20]*([#b♯♭]?)[\x09-\x0D\x1C-\x20]*(.*)\z"
        accidental, mode = F.regexp_extract(s, spelled, 2), strip(F.regexp_extract(s, spelled, 3))
        pitch = F.try_element_at(_literal_map(NATURAL), F.upper(F.regexp_extract(s, spelled, 1)))
        pitch = pitch + F.when(accidental.isin("#", "♯"), 1).when(accidental.isin("b", "♭"), -1).otherwise(0)
        low = F.lower(mode)
        scale = (
            F.when(mode.isin("m", "min"), "minor").when(mode.isin("M", "maj", ""), "major")
            .when(low.startswith("min") | (low == "m"), "minor").when(low.startswith("maj"), "major")
        )
        name = F.get(F.array(*[F.lit(n) for n in NAMES]), F.pmod(pitch, F.lit(12)))
        return (
            F.when(F.lower(s).isin(*NOT_A_KEY), None)
            .when(s.rlike(code), F.try_element_at(_literal_map(WHEEL), wheel))
            .when(s.rlike(spelled), F.concat(name, F.lit(" "), scale))
        )

    return bind(strip(F.coalesce(col(raw), F.lit(""))), read)


def to_camelot(key: Column | str) -> Column:
    return F.try_element_at(_literal_map({v: k for k, v in WHEEL.items()}), normalize_key(key))


def keys_agree(a: Column | str, b: Column | str) -> Column:
    """The same tonic and mode, both known."""
    return F.coalesce(normalize_key(a) == normalize_key(b), F.lit(False))


def combine_key_signals(override, tag, offline_key, offline_confidence, online) -> Column:
    """struct(key, confidence, source, detail) of what is known: manual, then tag, then audio, then online."""
    def result(key, confidence, source, detail) -> Column:
        return F.struct(key.cast("string").alias("key"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), detail.alias("detail"))

    def fuse(x: Column) -> Column:
        manual, tagged, heard, listed, heard_confidence = (x[n] for n in ("manual", "tagged", "heard", "listed", "confidence"))
        sure = F.coalesce(tagged == heard, F.lit(False)) | F.coalesce(tagged == listed, F.lit(False))
        agree = F.coalesce(heard == listed, F.lit(False))
        lifted = F.when(agree, F.least(F.lit(1.0), heard_confidence + 0.20)).otherwise(heard_confidence)
        heard_detail = F.when(listed.isNull(), "").when(agree, BOTH_AGREE).otherwise(F.concat(F.lit(ONLINE_DISAGREES), listed, F.lit(")")))
        return (
            F.when(manual.isNotNull(), result(manual, F.lit(1.0), "manual", F.lit("")))
            .when(tagged.isNotNull(), result(tagged, F.when(sure, 0.97).otherwise(0.90), "tag", F.when(sure, TAG_CORROBORATED).otherwise(TAG_ALONE)))
            .when(heard.isNotNull(), result(heard, F.round(lifted, 3), "auto", heard_detail))
            .when(listed.isNotNull(), result(listed, F.lit(0.50), "online", F.lit(ONLINE_ALONE)))
            .otherwise(result(F.lit(None), F.lit(0.0), "none", F.lit("")))
        )

    signals = {"manual": override, "tagged": tag, "heard": offline_key, "listed": online}
    known = F.struct(*[normalize_key(v).alias(k) for k, v in signals.items()], col(offline_confidence).cast("double").alias("confidence"))
    return bind(known, fuse)


def should_emit(source: Column | str, confidence: Column | str) -> Column:
    """Manual and tag keys always, others from a confidence of 0.5 on."""
    source = col(source)
    known = F.when(source.isin("manual", "tag"), True).when(source.isin("auto", "online"), col(confidence) >= EMIT_FROM)
    return F.coalesce(known, F.lit(False))


def key_index_fields(key, confidence, source, camelot) -> Column:
    """struct(key, key_confidence, key_source, key_camelot) that a copy publishes; null where it publishes none."""
    key, camelot = col(key), col(camelot)
    number = F.coalesce(F.nullif(col(confidence), F.lit("")).try_cast("double"), F.lit(0.0))
    origin = F.coalesce(col(source), F.lit("none"))
    fields = F.struct(key.alias("key"), F.round(number, 3).alias("key_confidence"), origin.alias("key_source"), F.nullif(camelot, F.lit("")).alias("key_camelot"))
    return F.when((F.coalesce(key, F.lit("")) != "") & should_emit(origin, number), fields)
