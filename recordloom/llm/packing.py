"""Token ids packed into rows of one length by best fit decreasing.

Documents are encoded, ended by an end id, and cut into pieces of the row length at most: the pieces of a document
joined give its ids again.  Pieces are placed longest first, each into the fullest row that has room; a segment tree
over the rooms finds it.  Partitions are packed by themselves, in blocks of bounded size, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filesystem, hold, raw, read_file, scratch, ship, write_file

ROW = 2048
#: Ids that are packed together, about, and packed rows of a set of files.
BLOCK_IDS = 4_000_000
SET_ROWS = 8192


class Rooms:
    """Open rows by the room they have left; a segment tree over rooms 0..size answers "the least room of at least n"."""

    def __init__(self, size: int):
        self.width = 1
        while self.width <= size:
            self.width *= 2
        self.counts = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.width
        while at:
            self.counts[at] += 1
            at //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room that is at least ``least``."""
        counts, at = self.counts, least + self.width
        while not counts[at]:
            while at & 1:  # a right child has nothing larger beside it
                at //= 2
            if not at:
                return None
            at += 1
            if not at & (at - 1):  # past the last of its level
                return None
        while at < self.width:
            at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.width
        row = self.rows[room].pop()
        while at:
            counts[at] -= 1
            at //= 2
        return room, row


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of positions in ``lengths`` (1..size each), packed longest first into the fullest row with room."""
    rooms, rows = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = rooms.take(n)
        if found is None:
            found = (size, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(k)
        rooms.add(room - n, row)
    return rows


_ENCODINGS: dict = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A worker's encoding for a file of ranks, loaded once."""
    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as src:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, src)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def encode(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    return codec.encode_to_numpy(text, disallowed_special=())


def pack(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", row: int = ROW, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows: ``row_id``, ``n_ids``, ``ids``, ``cu_seqlens``, ``position_ids``, ``doc_ids``, ``doc_starts``.

    ``ids`` holds ``row`` ids as little-endian uint16 (uint32 where the vocabulary is larger), filled up with
    ``end_id``; ``cu_seqlens`` the segments' bounds from 0 to ``n_ids``; ``position_ids`` uint16 or uint32 positions
    that start again from 0 at each segment and in the filling; ``doc_ids`` the key of each segment's document and
    ``doc_starts`` where in the document's ids the segment starts.  ``end_id`` is one past the vocabulary by default and
    ends each document; a null or empty text is an end id alone; longer ones are cut, however long.  Repeated rows are
    packed each; other columns are left out.  An empty table gives no rows.  Row ids are the partition's number times 2**40 and a running number.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("row_id", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_starts", T.ArrayType(T.LongType())),
    ])
    names = schema.names

    def run(batches):
        codec = encoding(path, pattern)
        end = codec.n_vocab if end_id is None else end_id
        dtype = "<u2" if max(codec.n_vocab, end) < 1 << 16 else "<u4"
        place = "<u2" if row <= 1 << 16 else "<u4"
        serial = TaskContext.get().partitionId() << 40
        owners, starts, pieces, total = [], [], [], 0

        def flush():
            nonlocal serial, owners, starts, pieces, total
            key_array = pa.concat_arrays(owner_parts) if owner_parts else None
            rows = best_fit([len(p) for p in pieces], row)
            for begin in range(0, len(rows), 512):
                ids, positions, bounds, members = [], [], [], []
                part = rows[begin : begin + 512]
                for own in part:
                    lengths = [len(pieces[k]) for k in own]
                    used = sum(lengths)
                    lengths_all = [*lengths, row - used] if used < row else lengths
                    ids.append(np.concatenate([*(pieces[k] for k in own), np.full(row - used, end, dtype=dtype)]).astype(dtype).tobytes())
                    positions.append(np.concatenate([np.arange(n, dtype=place) for n in lengths_all]).tobytes())
                    bounds.append(np.concatenate(([0], np.cumsum(lengths))).tolist())
                    members += own
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(own) for own in part]))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(serial, serial + len(part)), pa.int64()), pa.array([b[-1] for b in bounds], pa.int32()), pa.array(ids, pa.binary()), pa.array(bounds, pa.list_(pa.int32())), pa.array(positions, pa.binary()),
                    pa.ListArray.from_arrays(offsets, key_array.take(pa.array([owners[k] for k in members], pa.int64()))),
                    pa.ListArray.from_arrays(offsets, pa.array([starts[k] for k in members], pa.int64())),
                ], names=names)
                serial += len(part)
            owners, starts, pieces, total = [], [], [], 0

        owner_parts, held = [], 0
        for batch in batches:
            owner_parts.append(batch.column(0))
            for k, data in enumerate(raw(batch.column(1))):
                ids = np.append(encode(codec, (data or b"").decode()), end).astype(dtype)
                for start in range(0, len(ids), row):
                    pieces.append(ids[start : start + row])
                    owners.append(held + k)
                    starts.append(start)
                total += len(ids)
                if total >= block_ids:
                    yield from flush()
                    # Only the keys of rows to come are needed any more.
                    owner_parts, held = [batch.column(0).slice(k + 1)], -(k + 1)
            held += batch.num_rows
        if pieces:
            yield from flush()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def write_matrices(packed: DataFrame, folder: str, set_rows: int = SET_ROWS) -> DataFrame:
    """Write what :func:`pack` returned as files under the URI ``folder``, in sets of at most ``set_rows`` rows.

    ``-ids.bin``: a matrix, a row of ids a line.  ``-positions.bin``: the same of positions.  ``-cu_seqlens.bin``:
    uint32, for each row its number of segments and their bounds.  ``-documents.arrow``: row ids, keys and starts of the
    segments' documents.  Returns (name, n_rows) of each set; sets that aren't in it come from attempts that didn't count.
    """
    ship(packed.sparkSession)

    def run(batches):
        # Each attempt has names of its own; only those returned count.
        name, serial, held, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, [], 0

        def flush():
            own = pa.Table.from_batches(held)
            sizes = [np.array([len(b) - 1, *b], dtype="<u4").tobytes() for b in own.column("cu_seqlens").to_pylist()]
            docs = pa.BufferOutputStream()
            with pa.ipc.new_stream(docs, (side := own.select(["row_id", "doc_ids", "doc_starts"])).schema) as out:
                out.write_table(side)
            for what, parts in (("ids.bin", own.column("ids").to_pylist()), ("positions.bin", own.column("position_ids").to_pylist()), ("cu_seqlens.bin", sizes), ("documents.arrow", [docs.getvalue()])):
                write_file(f"{folder}/{name}-{serial:05d}-{what}", parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{serial:05d}"]), pa.array([n], pa.int64())], names=["name", "n_rows"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                held.append(batch.slice(begin, 512))
                n += held[-1].num_rows
                if n >= set_rows - 511:
                    yield flush()
                    serial, held, n = serial + 1, [], 0
        if n:
            yield flush()

    return packed.mapInArrow(run, "name string, n_rows long")


def read_matrices(sets: DataFrame, folder: str, schema: T.StructType) -> DataFrame:
    """The rows, with the columns ``schema`` of :func:`pack`, of sets (name, n_rows) that :func:`write_matrices` wrote."""
    ship(sets.sparkSession)
    names = schema.names

    def run(batches):
        for batch in batches:
            for name, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, places = (np.frombuffer(read_file(f"{folder}/{name}-{what}.bin"), np.uint8).reshape(n, -1) for what in ("ids", "positions"))
                flat = np.frombuffer(read_file(f"{folder}/{name}-cu_seqlens.bin"), "<u4")
                docs = pa.ipc.open_stream(read_file(f"{folder}/{name}-documents.arrow")).read_all().combine_chunks()
                at = 0
                for begin in range(0, n, 512):
                    bounds = []
                    for _ in range(min(512, n - begin)):
                        bounds.append(flat[at + 1 : at + 2 + flat[at]])
                        at += 2 + int(flat[at])
                    part = docs.slice(begin, 512).combine_chunks()
                    own = {
                        "row_id": part.column("row_id"), "n_ids": pa.array([int(b[-1]) for b in bounds], pa.int32()), "ids": pa.array([x.tobytes() for x in ids[begin : begin + 512]], pa.binary()),
                        "cu_seqlens": pa.array([b.astype(np.int32) for b in bounds], pa.list_(pa.int32())), "position_ids": pa.array([x.tobytes() for x in places[begin : begin + 512]], pa.binary()),
                        "doc_ids": part.column("doc_ids"), "doc_starts": part.column("doc_starts"),
                    }
                    yield from pa.table({c: own[c] for c in names}).to_batches()

    n = sets.count()
    spread = sets.select("name", "n_rows").repartition(max(1, n), F.xxhash64("name"))
    return spread.mapInArrow(run, schema)


def pack_to_files(docs: DataFrame, path: str, pattern: str, folder: str | None = None, **options) -> DataFrame:
    """:func:`pack`, written by :func:`write_matrices` under ``folder`` (one of our own if not given) and read from there."""
    packed = pack(docs, path, pattern, **options)
    folder = folder or scratch(docs.sparkSession, "matrices")
    return read_matrices(hold(write_matrices(packed, folder), "sets"), folder, packed.schema)


def read_matrix(uri: str, row: int = ROW, dtype: str = "<u2") -> np.ndarray:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as src:
        return np.frombuffer(src.read(), dtype=dtype).reshape(-1, row)
