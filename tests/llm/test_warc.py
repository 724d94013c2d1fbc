import hashlib
import io
import struct

import pytest

from recordloom.llm import warc as W
from recordloom.llm.shared import read_file
from recordloom.tables import scratch


def want(rows):
    out = {}
    for page, html in rows:
        data = (html or "").encode()
        same = [p for p, h in rows if (h or "") == (html or "")]
        refers = max(same) if len(data) >= 1000 and max(same) != page else None
        out[page] = (len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers)
    return out


def pages(spark):
    big = "<p>" + "äöü text " * 200
    rows = [(i, f"http://h/{i} x\r\ny" if i % 4 else None, [None, "", "short", big, big + "!", f"<p>{i} {big}", "\r\n\r\n" * 400][i % 7]) for i in range(120)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark):
    rows, df = pages(spark)
    for options in ({}, {"archive_bytes": 3000}):
        got = W.round_trip(df, **options).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want([(i, h) for i, _, h in rows])
        assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
        html = dict((i, h) for i, _, h in rows)
        assert all(bytes(r["payload"]).decode() == (html[r["page_id"]] or "") for r in got if r["payload"] is not None)


def test_dictionary_leads_and_records_stand_alone(spark):
    _, df = pages(spark)
    made = W.write_archives(df, scratch(spark, "test-warc")).collect()
    assert sum(r["n_records"] for r in made) == 120
    data = read_file(made[0]["path"])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    assert len(list(W.read_archive(io.BytesIO(data)))) == made[0]["n_records"]
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(data[:-5])))


def test_repeated_rows_null_keys_and_empty(spark):
    big = "x" * 2000
    rows = [(5, "u", big), (5, "u", big), (4, "u", big), (None, "u", big), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in W.round_trip(df).collect())
    assert got == [("4", "revisit", 5), ("5", "response", None), ("5", "response", None), ("None", "response", None), ("None", "response", None)]
    assert W.round_trip(df.limit(0)).count() == 0


def test_no_dictionary_from_too_little():
    assert W.dictionary([]) == b"" and W.dictionary([b"a"]) == b""


def test_keys_of_any_type_urls_and_record_ids(spark):
    big = "y" * 3000
    rows = [("a b\nc", "http://h/ x\r\n", big), ("é", None, big), (None, "", big), ("", " u ", None), ("z", "%20", "q"), ("z", "%20", "q")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    made = W.write_archives(df, scratch(spark, "test-warc"))
    got = W.read_archives(made, key_type="string").collect()
    assert sorted(((r["page_id"], r["url"]) for r in got), key=repr) == sorted(((i, u) for i, u, _ in rows), key=repr)
    assert {r["page_id"]: r["refers_to"] for r in got}["a b\nc"] == "é"
    heads = [W.parse(d)[0] for m in made.collect() for d in W.read_archive(io.BytesIO(read_file(m["path"])))]
    assert len({h["warc-record-id"] for h in heads}) == len(rows)
    known = {h["warc-record-id"] for h in heads}
    assert all(h["warc-refers-to"] in known for h in heads if h["warc-type"] == "revisit")
