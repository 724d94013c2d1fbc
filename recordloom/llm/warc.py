"""WARC archives compressed with a Zstandard dictionary.

An archive starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, built from a bounded
sample of the records; each record is a frame of its own, compressed with it.  Of equal payloads one is a response
record, the others revisit it; only payloads that a Bloom filter finds possibly repeated are shuffled to find it.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact_dedup import possible_repeats
from .shared import filesystem, hold, raw, scratch, ship, write_file

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records that a dictionary is built from, and bytes of each, at most.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 16 << 10
#: Uncompressed bytes after which the next archive begins.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: str) -> uuid.UUID:
    """Of a response that others revisit."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")


def record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None = None, uid: uuid.UUID | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its length and digest.

    Keys and urls that a header can't hold as they are, and missing ones, are there in JSON too.
    """
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid or record_id(page)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {json.dumps(page)}", f"X-Payload-Length: {length}",
    ]
    if target != url or target != target.strip():
        head.append(f"X-Target: {json.dumps(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to)}>", f"X-Refers-To-Page-Id: {json.dumps(refers_to)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the HTTP payload of a record; torn records raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if len(body) != int(fields["content-length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("torn WARC record")
    return fields, body.partition(b"\r\n\r\n")[2]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of ``samples``; empty where they are too few or too alike to build one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Frames of an archive: the dictionary's, then a record's each."""

    def __init__(self, words: bytes, level: int = LEVEL):
        own = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, **own)
        self.frames = [struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words]
        self.bytes = 0

    def add(self, data: bytes) -> None:
        self.frames.append(self.compressor.compress(data))
        self.bytes += len(data)


def read_archive(stream):
    """The records of an archive, one after the other, from a stream with read(n)."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    words = stream.read(size)
    own = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    decompressor = zstandard.ZstdDecompressor(**own)
    unit, left = decompressor.decompressobj(), b""
    parts: list[bytes] = []
    while True:
        # What follows a frame is copied, so little is read at a time; the stream below has a buffer.
        chunk = left or stream.read(1 << 14)
        left = b""
        if not chunk:
            if parts:
                raise ValueError("torn archive")
            return
        parts.append(unit.decompress(chunk))
        if unit.eof:
            yield b"".join(parts)
            left, parts, unit = unit.unused_data, [], decompressor.decompressobj()


def plan(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(page, url, html, n_bytes, digest, refers_to, head): refers_to is null for responses, head is whether others
    revisit it.  Payloads that no other can equal stay where they are."""
    empty = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), empty.alias("html"))
    rows = rows.withColumns({"n_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html"), "strong": F.sha2("html", 256)})
    tested = possible_repeats(rows, "strong").withColumn("maybe", F.col("maybe") & (F.col("n_bytes") >= min_bytes))
    # Only digests are grouped; of copies, those that aren't the last find it, and AQE splits large groups.
    several = tested.where("maybe")
    heads = several.groupBy("strong").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = several.join(heads.withColumnRenamed("strong", "_strong"), F.col("strong") == F.col("_strong"), "left")
    refers, head = F.when(F.col("last") != F.col("page"), F.col("last")), F.coalesce(F.col("last") == F.col("page"), F.lit(False))
    names = ("page", "url", "html", "n_bytes", "digest")
    alone = tested.where("not maybe").select(*names, F.lit(None).cast(rows.schema["page"].dataType).alias("refers_to"), F.lit(False).alias("head"))
    return alone.unionByName(met.select(*names, refers.alias("refers_to"), head.alias("head")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row into archives under the URI ``folder``; returns (path, n_records), already written.

    Archives that aren't in the result come from attempts that didn't count.

    A null payload is empty; a null url stays null; keys are of any type that strings can be cast to.  Of equal
    payloads of at least ``min_bytes`` bytes, the row with the largest key is the response that the others revisit; rows
    with a null key, and all rows that share that largest key, are responses.  Payloads are written whole, however long.
    Other columns are left out.  An empty table makes no archive.

    A record's id is its own; only that of a revisited response comes from its key, so that those that revisit it know
    it (rows that share the key and the payload share it too).
    """
    spark = pages.sparkSession
    ship(spark)
    total = pages.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    chosen = pages.where(F.col(payload).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    # A bounded sample: rows, and of long ones the start.
    samples = [record("response", "0", "", bytes(r[0]), "0" * 40, len(r[0])) for r in chosen.select(F.substring(F.col(payload).cast("binary"), 1, SAMPLE_BYTES)).limit(SAMPLE_ROWS).collect()]
    words = spark.sparkContext.broadcast(dictionary(samples))

    def run(batches):
        # A repeated task may deal its rows to archives in another order, so each attempt has names of its own.
        part, serial, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, 0
        writer = Writer(words.value)

        def flush():
            path = f"{folder}/{part}-{serial:05d}.warc.zst"
            write_file(path, writer.frames)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

        for batch in batches:
            pages_, urls, sizes, digests, refers, heads = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            for i, html in enumerate(raw(batch.column(2))):
                kind = "response" if refers[i] is None else "revisit"
                own = None if heads[i] else uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{serial}/{n}")
                writer.add(record(kind, pages_[i], urls[i], html if refers[i] is None else b"", digests[i], sizes[i], refers[i], own))
                n += 1
                if writer.bytes >= archive_bytes:
                    yield flush()
                    writer, serial, n = Writer(words.value), serial + 1, 0
        if n:
            yield flush()

    rows = plan(pages, key, url, payload, min_bytes).withColumns({"page": F.col("page").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    written = rows.mapInArrow(run, "path string, n_records long")
    return hold(written, "archives")


def read_archives(archives: DataFrame, with_payload: bool = True, key_type: str = "long") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of archives' records.

    ``archives`` has a column ``path``; keys come back as ``key_type``.  A revisit's payload is null, its bytes and digest are those of the payload it
    stands for.  A response's payload is checked against its digest, and null without ``with_payload``.
    """
    ship(archives.sparkSession)
    schema = T.StructType([
        T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()),
    ])

    def rows(path):
        fs, inner = filesystem(path)
        with fs.open_input_stream(inner, compression=None, buffer_size=1 << 20) as stream:
            for data in read_archive(stream):
                fields, payload = parse(data)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(fields["x-payload-length"])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError("payload differs from its digest")
                page, refers = json.loads(fields["x-page-id"]), json.loads(fields.get("x-refers-to-page-id", "null"))
                url = json.loads(fields["x-target"]) if "x-target" in fields else fields["warc-target-uri"]
                yield (page, url, payload if kind == "response" and with_payload else None, size, digest, kind, refers)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size > 8 << 20 or len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=schema.names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=schema.names)

    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    n = archives.count()
    read = archives.select("path").repartition(n, F.xxhash64("path")).mapInArrow(run, schema) if n else archives.sparkSession.createDataFrame([], schema)
    return read.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, with_payload: bool = True, key: str = "page_id", **options) -> DataFrame:
    """Write archives of ``pages`` into the shared folder and read them back."""
    written = write_archives(pages, scratch(pages.sparkSession, "warc"), key=key, **options)
    return read_archives(written, with_payload, pages.schema[key].dataType.simpleString())
