"""Near copies: SimHash fingerprints find candidates over vantage-point trees, and shingle sets decide exactly.

Each text has ``TABLES`` fingerprints, each of the distinct words in a part of it that anchors cut out, which are
word pairs of least hash in that table's order: changed words move a fingerprint by few bits, and what is added or cut
elsewhere leaves a part as it was.  The trees of :mod:`simhash` bring together all pairs within ``BITS`` bits in a table.
A wide fingerprint of the shingles then drops pairs that are far from similar, and the sets of shingles decide the rest.

Where many are near each other, pairs aren't written out: a forest of them joins such texts to clusters, the texts of a
cluster meet with their sets, each is compared with those that aren't in its group yet, and a forest of links comes out.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import mix
from .shared import hold, raw, ship, tidy
from .simhash import Forest, blocks, components, deal_parts, keep_heads, link_rows, route_fingerprints, vote, with_rows

TABLES = 16
BITS = 3
#: 64-bit parts of the wide fingerprint, and bits in which those of similar texts differ at most: at a similarity of 0.8
#: a bit differs with a probability of 0.151, so 38.8 on average with a deviation of 5.7.
WIDE = 4
WIDE_BITS = 60
#: Pairs a row beyond which a block is dense; neighbours of a row in it that are written out as pairs; and rows with their
#: sets that a task takes, about.
DENSE = 4
NEIGHBOURS = 8
DENSE_ROWS = 8192
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_codes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, A-Z lower-cased, and for each word of the text which of them it is."""
    places: dict[bytes, int] = {}
    at = np.array([places.setdefault(w, len(places)) for w in (text or b"").lower().split()], dtype=np.int64)
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in places), dtype=np.uint64, count=len(places)), at


def shingle_set(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of each run of ``size`` words, of all words where there are fewer; none without words."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    run = min(size, len(at))
    words, n = hashes[at], len(at) - run + 1
    rolling = np.full(n, run, dtype=np.uint64)
    for k in range(run):
        rolling = mix(rolling * np.uint64(0x100000001B3) + words[k : k + n], k)
    return np.unique(rolling)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def part_prints(texts: list[tuple[np.ndarray, np.ndarray]], tables: int = TABLES) -> np.ndarray:
    """Array (texts, tables) of fingerprints of the distinct words in each table's part of a text.

    The table's order of word pairs gives two anchors, the first places of the two least.  In even tables the part is
    what lies between them where that is a quarter of the text or more, and else the longer of what is before and after
    both; in odd ones what is on the shorter side of the first anchor where that is a quarter, and else the longer side.
    So edits at both ends spare some parts, and those in the middle others.
    """
    out = np.zeros((len(texts), tables), dtype=np.uint64)
    live = np.array([k for k, (h, _) in enumerate(texts) if len(h)], dtype=np.int64)
    if not len(live):
        return out
    sizes = np.array([len(texts[k][0]) for k in live])
    lengths = np.array([len(texts[k][1]) for k in live])
    hashes = np.concatenate([texts[k][0] for k in live])
    starts, begins = _starts(sizes), _starts(lengths)
    code = np.concatenate([texts[k][1] for k in live]) + np.repeat(starts, lengths)
    place = np.arange(len(code)) - np.repeat(begins, lengths)
    words = hashes[code]
    # A text's last word makes a pair with itself, so that each word starts one.
    after = np.minimum(np.arange(len(code)) + 1, np.repeat(begins + lengths - 1, lengths))
    pairs = words * np.uint64(0x100000001B3) + words[after]
    for t in range(tables):
        order = mix(pairs, 2 * t)
        least = np.repeat(np.minimum.reduceat(order, begins), lengths)
        anchor = np.minimum.reduceat(np.where(order == least, place, len(code)), begins)
        if t % 2:
            short = 4 * np.minimum(anchor + 1, lengths - anchor) >= lengths
            front = (2 * anchor + 1 < lengths) == short
            low, high = np.where(front, 0, anchor), np.where(front, anchor, lengths)
        else:
            order = np.where(order == least, _LAST, order)
            least = np.repeat(np.minimum.reduceat(order, begins), lengths)
            other = np.minimum.reduceat(np.where(order == least, place, len(code)), begins)
            one, two = np.minimum(anchor, other), np.maximum(anchor, other)
            middle, front = 4 * (two - one) >= lengths, one + 1 >= lengths - two
            low = np.where(middle | ~front, np.where(middle, one, two), 0)
            high = np.where(middle, two, np.where(front, one, lengths))
        inside = (place >= np.repeat(low, lengths)) & (place <= np.repeat(high, lengths))
        taken = np.zeros(len(hashes), dtype=bool)
        taken[code[inside]] = True
        out[live, t] = vote(mix(hashes[taken], 2 * t + 1), np.add.reduceat(taken.astype(np.int64), starts))
    return out


def with_prints(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, mark, digest of the set of shingles, n of them, fps, w0..) of each row."""
    ship(docs.sparkSession)
    longs = T.ArrayType(T.LongType())
    wide = [f"w{k}" for k in range(WIDE)]
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("mark", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("fps", longs), *[T.StructField(w, T.LongType()) for w in wide],
    ])

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [word_codes(t) for t in raw(part.column(2))]
                sets = [shingle_set(*t, size) for t in texts]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets)
                prints = part_prints(texts).view(np.int64)
                far = [vote(mix(flat, 100 + k), sizes).view(np.int64) for k in range(WIDE)]
                columns = [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TABLES), pa.array(prints.ravel())),
                    *map(pa.array, far),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)

    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, schema)


def with_sets(docs: DataFrame, nodes: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(node, hs): the set of shingles of each of ``nodes`` (node, id, mark), from the rows with that key and text."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("hs", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(*word_codes(t), size).view(np.int64) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    met = rows.join(nodes, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark"))).select("node", "_text")
    return met.mapInArrow(run, schema).groupBy("node").agg(F.first("hs").alias("hs"))


def _near(own: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of positions within ``bits`` bits; None where there are more than ``most``."""
    left, right, found = [], [], 0
    for start in range(0, len(own), 64):
        a, b = np.nonzero(np.bitwise_count(own[start : start + 64, None] ^ own[None, start:]) <= bits)
        later = b > a
        left.append(start + a[later])
        right.append(start + b[later])
        found += len(left[-1])
        if found > most:
            return None
    return np.concatenate(left), np.concatenate(right)


def _crowded(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pairs of positions within ``bits`` bits, of those with few neighbours, and a forest of the pairs among the others."""
    left, right, few = [], [], np.zeros(len(own), dtype=bool)
    for start in range(0, len(own), 64):
        near = np.bitwise_count(own[start : start + 64, None] ^ own[None, :]) <= bits
        low = near.sum(axis=1) <= NEIGHBOURS + 1
        few[start : start + 64] = low
        a, b = np.nonzero(near[low])
        left.append(start + np.flatnonzero(low)[a])
        right.append(b)
    forest = Forest(len(own))
    link_rows(own, np.flatnonzero(~few), bits, forest)
    return np.concatenate(left), np.concatenate(right), forest.links


def candidates(nodes: DataFrame, bits: int = BITS, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``nodes`` (table, fp, node) to compare; and links (a, b) of nodes with many neighbours, whose pairs
    aren't among them, but are within what these links join."""
    schema = T.StructType([T.StructField("many", T.BooleanType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def within(group: pa.Table) -> pa.Table:
        prints = group.column("fp").to_numpy().view(np.uint64)
        ids, out = group.column("node").to_numpy(), []

        def emit(many, a, b):
            out.append(pa.table([pa.array(np.full(len(a), many)), np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], names=schema.names))

        for rows in blocks(prints, bits):
            found = _near(prints[rows], bits, DENSE * len(rows))
            if found is None:
                *found, links = _crowded(prints[rows], bits)
                links = np.array(links, dtype=np.int64).reshape(-1, 2)
                emit(True, rows[links[:, 0]], rows[links[:, 1]])
            emit(False, rows[found[0]], rows[found[1]])
        return pa.concat_tables(out)

    routed, large = route_fingerprints(nodes, bits, **options)
    found = hold(deal_parts(routed, large).groupBy("shard", "i", "j").applyInArrow(within, schema), "candidates")
    return tuple(found.where("a <> b").where(which).select("a", "b").distinct() for which in ("not many", "many"))


def shared(own: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes of the sorted set ``own`` each of some sets has, which start in ``flat`` at ``starts``."""
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    here = flat[at]
    hit = own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here
    return np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64))


def dense_links(wide: list[np.ndarray], flat: np.ndarray, offsets: np.ndarray, tenths: int) -> list[tuple[int, int]]:
    """A forest of the links among rows whose sets, which ``flat`` holds between ``offsets``, are similar; rows of one
    group aren't compared."""
    sizes, n = np.diff(offsets), len(offsets) - 1
    label, forest = np.arange(n), Forest(n)
    for a in range(n - 1):
        near = np.flatnonzero(label[a + 1 :] != label[a]) + a + 1
        near = near[10 * np.minimum(sizes[near], sizes[a]) >= tenths * np.maximum(sizes[near], sizes[a])]
        far = sum(np.bitwise_count(w[near] ^ w[a]).astype(np.int64) for w in wide)
        near = near[np.argsort(far, kind="stable")][: int((far <= WIDE_BITS).sum())]
        for begin in range(0, len(near), 64):
            some = near[begin : begin + 64]
            some = some[(label[some] != label[a]) & (sizes[some] > 0)]
            if not len(some):
                continue
            both = shared(flat[offsets[a] : offsets[a + 1]], flat, offsets[some], sizes[some])
            for b in some[both * (10 + tenths) >= (sizes[some] + sizes[a]) * tenths].tolist():
                if label[b] != label[a]:
                    forest.join(a, b)
                    label[label == label[b]] = label[a]
    return forest.links


def links_of_dense(rows: DataFrame, tenths: int, most: int = DENSE_ROWS) -> DataFrame:
    """Links (a, b) of rows (shard, node, w0.., hs), as :func:`dense_links` finds them in each shard."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def within(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets, ids = group.column("hs").chunk(0), group.column("node").to_numpy()
        wide = [group.column(f"w{k}").to_numpy().view(np.uint64) for k in range(WIDE)]
        offsets, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy().view(np.uint64)
        links = np.array(dense_links(wide, flat, offsets, tenths), dtype=np.int64).reshape(-1, 2)
        return pa.table([ids[links[:, 0]], ids[links[:, 1]]], names=["a", "b"])

    large = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).withColumn("parts", F.ceil(2 * F.col("n") / most))
    return deal_parts(rows, hold(large, "large")).groupBy("shard", "i", "j").applyInArrow(within, schema)


def _wide_distance(left: str, right: str) -> Column:
    return reduce(add, (F.bit_count(F.col(f"{left}w{k}").bitwiseXOR(F.col(f"{right}w{k}"))) for k in range(WIDE)))


def near_pairs(pairs: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that can be similar, by size and wide fingerprint, of ``nodes`` (node, n, w0..)."""
    wide = [f"w{k}" for k in range(WIDE)]
    x, y = (nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), *[F.col(w).alias(f"{side}{w}") for w in wide]) for side in "ab")
    sized = F.least("an", "bn") * 10 >= F.greatest("an", "bn") * tenths
    return pairs.join(x, "a").join(y, "b").where(sized & (_wide_distance("a", "b") <= WIDE_BITS)).select("a", "b")


def similar_pairs(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (node, hs) have a similarity of ``tenths`` / 10 or more."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * (10 + tenths) >= (F.size("x") + F.size("y")) * tenths).select("a", "b")


def similar_links(nodes: DataFrame, sets_of, tenths: int, bits: int = BITS, **options) -> DataFrame:
    """Links (a, b), enough to join all similar ``nodes`` (node, id, mark, n, fps, w0..) that a table brings together.

    ``sets_of`` gives (node, hs) for some of the nodes.
    """
    pairs, many = candidates(nodes.select(F.posexplode("fps").alias("table", "fp"), "node"), bits, **options)
    pairs = hold(near_pairs(pairs, nodes, tenths), "near")
    dense = components(many).withColumnRenamed("component", "shard")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dense.select("node")).distinct()
    sets = hold(sets_of(hold(nodes.join(wanted, "node", "left_semi").select("node", "id", "mark"), "wanted")), "sets")
    rows = dense.join(nodes.select("node", *[f"w{k}" for k in range(WIDE)]), "node").join(sets, "node")
    # One after the other, so that the sets that one of them shuffles are gone before the other begins.
    return hold(similar_pairs(pairs, sets, tenths), "similar").unionByName(hold(links_of_dense(rows, tenths), "crowded"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, tenths: int = 8, **options) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a similarity of ``tenths`` / 10 or more, the one with the
    smallest key, null last; all columns stay.

    The similarity is that of the sets of shingles of ``size`` words, A-Z lower-cased, between ASCII white space.
    Texts of fewer words have all of them as one shingle; null and wordless texts are equal; texts are read whole,
    however long.  Rows are linked, not keys; of rows that share the kept key and text one stays.  An empty table
    stays empty.  Links that no table's fingerprints bring within ``BITS`` bits are missed; see the README for how many.
    """
    with tidy(docs.sparkSession) as keep:
        rows = with_rows(with_prints(docs, text, key, size), "prints")
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "row")).alias("first")
        heads = rows.groupBy("digest").agg(first).select("first").withColumn("node", F.col("first.row"))
        own = rows.join(heads.select("node"), F.col("row") == F.col("node"), "left_semi")
        nodes = hold(own.select(F.col("row").alias("node"), "id", "mark", "n", "fps", *[f"w{k}" for k in range(WIDE)]), "nodes")
        links = similar_links(nodes, lambda some: with_sets(docs, some, text, key, size), tenths, **options)
        order = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "node")).alias("first")
        found = nodes.join(components(links), "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(order)
        kept = keep(found.select("first.id", "first.mark"), "kept")
        return keep_heads(docs, rows, kept, text, key)
