"""Line dedup by a sharded minimal perfect hash.

Lines are known by a 128-bit hash of their key.  One pass counts in how many documents each hash occurs; the hashes of
enough documents are dealt into shards, and for each shard a minimal perfect hash is built (levels of bits: a
hash that shares its bit with none takes it, the others go to the next level; its slot is the rank of its bit).  The
slot indexes a fingerprint array (the half of the hash that the bits don't use) and a count array.  A hash that isn't
in the arrays fails the fingerprint and occurs in too few documents.  Documents then probe the arrays: no line is joined.
Those of a few batches probe together, shard by shard, so each shard is read once for them.
"""

from __future__ import annotations

import io
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_held, free_name, hold, raw, read_file, scratch, ship, write_file

#: Hashes of one shard, about; bytes of shards that a worker keeps at hand, and of texts whose lines probe together.
SHARD_KEYS = 1 << 16
CACHE_BYTES = 96 << 20
PROBE_BYTES = 32 << 20
STRIP = b" \t\n\x0b\x0c\r"
MAX_LEVELS = 48


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, another one for each salt."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a slot of 0..n-1 each, others get any slot or -1.

    Bits are packed; a slot is the rank of its bit, worked out from a count for each 64 bits.
    """

    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        self.sizes, self.words = sizes, words  # of each level, in bits, and its bits as uint64
        self.ranks, base = [], 0
        for bits in words:
            ones = np.bitwise_count(bits).astype(np.int64)
            ends = np.cumsum(ones)
            self.ranks.append((ends - ones + base).astype(np.uint32))
            base += int(ends[-1]) if len(ends) else 0

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, words, left = [], [], keys.astype(np.uint64)
        while len(left):
            if len(sizes) >= MAX_LEVELS:
                raise ValueError("keys of a perfect hash have to be distinct")
            size = max(8, int(len(left) * gamma))
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            padded = np.zeros(-(-size // 64) * 64, dtype=bool)
            padded[:size] = bits
            sizes.append(size)
            words.append(np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~bits[at]]
        return cls(sizes, words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for k, (size, words, ranks) in enumerate(zip(self.sizes, self.words, self.ranks, strict=True)):
            if not len(todo):
                break
            at = mix(keys[todo], k) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[todo[found]] = ranks[word[found]] + np.bitwise_count(below).astype(np.int64)
            todo = todo[~found]
        return out


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.mph, self.prints, self.counts = mph, prints, counts

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Shard:
        # Distinct 128-bit hashes with one equal half are told apart by mixing the halves.
        keys = high ^ mix(low, 99)
        mph = PerfectHash.build(keys)
        slots = mph.slots(keys)
        prints, n = np.empty_like(low), np.empty(len(counts), dtype=np.uint32)
        prints[slots] = low
        n[slots] = np.minimum(counts, 0xFFFFFFFF)
        return cls(mph, prints, n)

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents of each hash; 1 for hashes that the shard hasn't."""
        slots = self.mph.slots(high ^ mix(low, 99))
        out = np.ones(len(high), dtype=np.int64)
        if len(self.prints):
            here = (slots >= 0) & (self.prints[np.maximum(slots, 0)] == low)
            out[here] = self.counts[slots[here]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        words = np.concatenate(self.mph.words) if self.mph.words else np.zeros(0, dtype=np.uint64)
        np.savez(out, sizes=np.array(self.mph.sizes, dtype=np.int64), words=words, prints=self.prints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as z:
            sizes = z["sizes"].tolist()
            words = np.split(z["words"], np.cumsum([-(-n // 64) for n in sizes])[:-1]) if sizes else []
            return cls(PerfectHash(sizes, words), z["prints"], z["counts"])

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes + r.nbytes for w, r in zip(self.mph.words, self.mph.ranks, strict=True)) + self.prints.nbytes + self.counts.nbytes


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class Index:
    """The shards as files ``folder``/shard-k.npz; a worker keeps those it used last, within a bound."""

    def __init__(self, folder: str, shards: int, cache_bytes: int = CACHE_BYTES):
        self.folder, self.shards, self.cache_bytes, self.reads = folder, shards, cache_bytes, 0
        self.kept: OrderedDict[int, Shard] = OrderedDict()

    def shard(self, k: int) -> Shard:
        if k not in self.kept:
            self.reads += 1
            self.kept[k] = Shard.load(read_file(shard_path(self.folder, k)))
            while len(self.kept) > 1 and sum(s.nbytes for s in self.kept.values()) > self.cache_bytes:
                self.kept.popitem(last=False)
        self.kept.move_to_end(k)
        return self.kept[k]

    def count(self, digests: list[bytes]) -> np.ndarray:
        """Documents of each digest, 1 for those not in the index; each shard is looked up once."""
        halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        high, low = halves[:, 0].copy(), halves[:, 1].copy()
        out = np.ones(len(high), dtype=np.int64)
        if not self.shards:
            return out
        home = shard_of(high, self.shards)
        order = np.argsort(home, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(part):
                out[part] = self.shard(int(home[part[0]])).count(high[part], low[part])
        return out


def shard_path(folder: str, k: int) -> str:
    return f"{folder}/shard-{k:08d}.npz"


def split_lines(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Lines as they are, and their keys: white space stripped at both ends, A-Z lower-cased."""
    text = text or b""
    return text.split(b"\n"), [line.strip(STRIP) for line in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points."""
    if len(key) < min_chars:
        return False
    return min_chars <= 1 or sum(b & 0xC0 != 0x80 for b in key) >= min_chars


def count_lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(high, low, n): the documents in which each line key occurs."""
    schema = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("n", T.LongType())])

    def flush(seen: Counter):
        halves = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)
        n = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
        return pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(n)], names=["high", "low", "n"])

    def run(batches):
        seen: Counter = Counter()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for value in raw(batch.column(0)):
                keys = {k for k in split_lines(value)[1] if long_enough(k, min_chars)}
                seen.update(map(digest, keys))
                if len(seen) > 200_000:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("high", "low").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text", min_chars: int = 1, index_from: int = 2, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Folder and number of the shards over the line hashes of at least ``index_from`` documents."""
    spark = docs.sparkSession
    ship(spark)
    folder = scratch(spark, "line-index")
    counted = hold(count_lines(docs, text, min_chars).where(F.col("n") >= index_from), "lines")
    shards = -(-counted.count() // shard_keys)
    if shards:
        def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            high, low = (group.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            # A shard none of whose hashes is left over is written too, so that a missing file is an error.
            write_file(shard_path(folder, key[0].as_py()), [Shard.build(high, low, group.column("n").to_numpy()).dump()])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())})

        # The shard is ((unsigned high) >> 32) % shards, as in shard_of; a null row for each stands for empty ones.
        dealt = counted.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 32), F.lit(shards)))
        made = hold(dealt.groupBy("shard").applyInArrow(build, "shard long"), "shards")
        empty = spark.range(shards).withColumnRenamed("id", "shard").join(made, "shard", "left_anti")

        def fill(batches):
            none = np.zeros(0, dtype=np.uint64)
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    write_file(shard_path(folder, k), [Shard.build(none, none, none.astype(np.int64)).dump()])
                yield batch

        empty.mapInArrow(fill, "shard long").count()
        drop_held(made)
    drop_held(counted)
    return folder, shards


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, index_from: int | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` without the lines whose key occurs in ``min_docs`` documents, with ``n_lines`` and ``n_dropped``.

    Texts are split at \n, whole, however long; null or empty is one empty line, and comes back as the empty text.  A
    key is the line stripped of ASCII white space with A-Z lower-cased; keys of fewer than ``min_chars`` code points
    always stay.  Each row is a document: a key counts once for each row it occurs in, also where rows share an id or
    are repeated.  The index holds keys of ``index_from`` documents or more, of ``min_docs`` if not given.  Other columns
    stay as they are; where they are called ``n_lines`` or ``n_dropped``, the new ones get underscores before their
    names.  An empty table gives an empty one.
    """
    folder, shards = build_index(docs, text, min_chars, min(index_from or min_docs, min_docs), shard_keys)
    lines_name = free_name(docs.columns, "n_lines")
    dropped_name = free_name(docs.columns, "n_dropped")
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(lines_name, T.LongType()), T.StructField(dropped_name, T.LongType())])
    at = docs.columns.index(text)
    names = [*docs.columns, lines_name, dropped_name]

    def settle(parts, index):
        digest = xxhash.xxh3_128_digest
        own = [{digest(k) for value in raw(part.column(at)) for k in split_lines(value)[1] if long_enough(k, min_chars)} for part in parts]
        flat = list(set().union(*own))
        common = {d for d, n in zip(flat, index.count(flat), strict=True) if n >= min_docs} if flat else set()
        for part, mine in zip(parts, own, strict=True):
            some = not common.isdisjoint(mine)
            kept, total, dropped = [], [], []
            for value in raw(part.column(at)):
                if some:
                    lines, keys = split_lines(value)
                    stay = [x for x, k in zip(lines, keys, strict=True) if not long_enough(k, min_chars) or digest(k) not in common]
                    kept.append(b"\n".join(stay))
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                else:
                    kept.append(value or b"")
                    total.append((value or b"").count(b"\n") + 1)
                    dropped.append(0)
            columns = list(part.columns)
            columns[at] = pa.array(kept, type=pa.binary()).cast(pa.string())
            columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        index, parts, size = Index(folder, shards), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                parts.append(batch.slice(start, 1000))
                size += parts[-1].column(at).get_total_buffer_size() * len(parts[-1]) // max(1, batch.num_rows)
                if size > PROBE_BYTES:
                    yield from settle(parts, index)
                    parts, size = [], 0
        yield from settle(parts, index)

    return docs.mapInArrow(run, schema)
