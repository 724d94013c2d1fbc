"""SimHash near-dedup over vantage-point trees.

A fingerprint has a bit for each bit of its shingles' hashes, set where most hashes set it.  Equal fingerprints are
one node.  A tree of vantage points, built from a bounded sample, cuts the space of fingerprints into shards: those at
most ``radius`` bits from a vantage point go inside, the others outside.  By the triangle inequality a link of up to
``bits`` bits can only cross the boundary from the last ``bits`` shells inside, so those are copied to the outside
shard: every link has a shard with both its ends, in which it is found by going on in the same way.  Each shard
returns a spanning forest of its links, not all pairs, and the forests are joined to components by alternating large
and small stars.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import mix
from .shared import drop_held, free_name, hold, raw, ship

SHINGLE = 3
MAX_BITS = 2
#: Fingerprints that the tree of vantage points is built from, at most.
SAMPLE = 1 << 16
#: Fingerprints of a shard, about: this many, or 64 times the root of all where that is more, so that the copies over
#: boundaries grow slowly.  A shard that is SHARD_OVER times as large, as nothing divides it, is dealt out by midpoints.
SHARD = 1 << 13
SHARD_ROOTS = 64
SHARD_OVER = 4
#: Fingerprints that are compared each with each, without a tree.
SMALL = 1 << 10
#: Hashes that vote at once, so that a very long text needs no more memory.
VOTES = 1 << 18
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lower-cased; of all words where there are fewer."""
    found = (text or b"").lower().split()
    if not found:
        return []
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def vote(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``sizes`` hashes: bits set in over half of them; zero for none."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    if not len(hashes):
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.zeros(len(sizes) * 2048, dtype=np.int64)
    for start in range(0, len(hashes), VOTES):
        part = hashes[start : start + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        at = owner[start : start + VOTES, None] * 2048 + np.arange(8) * 256 + part
        counts += np.bincount(at.ravel(), minlength=len(counts))
    ones = counts.reshape(len(sizes), 8, 256) @ _BYTE_BITS
    bits = (2 * ones.reshape(len(sizes), 64) > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: list[bytes | None], size: int = SHINGLE, tables: int = 1) -> np.ndarray:
    """An array (texts, tables) of fingerprints; the first table's hash is XXH64 itself, the others are mixed from it."""
    out = np.zeros((len(texts), tables), dtype=np.uint64)
    start, hashes, sizes = 0, [], []
    for k, text in enumerate(texts):
        own = shingle_hashes(text, size)
        hashes += own
        sizes.append(len(own))
        if len(hashes) > 100_000 or len(sizes) == 500 or k == len(texts) - 1:
            h, n = np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
            for j in range(tables):
                out[start : k + 1, j] = vote(mix(h, j) if j else h, n)
            start, hashes, sizes = k + 1, [], []
    return out


def _prints_column(text, size: int, tables: int) -> pa.ListArray:
    prints = fingerprints(raw(text), size, tables)
    offsets = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * tables)
    return pa.ListArray.from_arrays(offsets, pa.array(prints.view(np.int64).ravel()))


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, tables: int = 1) -> DataFrame:
    """(id, mark, fps array<long>) of each row; ``mark`` is a hash of the text."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("mark", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _prints_column(batch.column(2), size, tables)], names=schema.names)

    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, schema)


def with_rows(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, with a number for each row in a column ``row``."""
    return hold(df.withColumn("row", F.monotonically_increasing_id()), label)


# ------------------------------------------------------------- vantage points


def distances(prints: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point)).astype(np.int64)


def choose_split(prints: np.ndarray, bits: int) -> tuple[int, int] | None:
    """Vantage point and radius with a small larger side; None where none makes it less than 0.85 of the whole."""
    best, n = None, len(prints)
    for k in range(8):
        point = int(prints[(n * k) // 8])
        inside = np.cumsum(np.bincount(distances(prints, point), minlength=65))[:64]
        outside = n - np.concatenate((np.zeros(bits, dtype=np.int64), inside[: 64 - bits]))
        larger = np.maximum(inside, outside)
        score = np.where((inside > 0) & (inside < n) & (larger < 0.85 * n), 0.5 * (inside + outside - n) + larger, np.inf)
        radius = int(score.argmin())
        if score[radius] < np.inf and (best is None or score[radius] < best[0]):
            best = (score[radius], point, radius)
    return best and best[1:]


class VantageTree:
    """Nodes (point, radius, inside, outside); a negative number -k-1 is shard k."""

    def __init__(self, sample: np.ndarray, bits: int, leaf: int):
        self.bits, self.nodes, self.shards = bits, [], 0
        self.root = self._build(np.unique(sample), max(16, leaf))

    def _build(self, prints: np.ndarray, leaf: int) -> int:
        split = choose_split(prints, self.bits) if len(prints) > leaf else None
        if split is None:
            self.shards += 1
            return -self.shards
        point, radius = split
        at = len(self.nodes)
        self.nodes.append(None)
        d = distances(prints, point)
        self.nodes[at] = (point, radius, self._build(prints[d <= radius], leaf), self._build(prints[d > radius - self.bits], leaf))
        return at

    def route(self, prints: np.ndarray):
        """(shard, positions) of all shards that ``prints`` belong to or reach over a boundary."""
        stack = [(self.root, np.arange(len(prints)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            point, radius, inside, outside = self.nodes[node]
            d = distances(prints[rows], point)
            stack += [(inside, rows[d <= radius]), (outside, rows[d > radius - self.bits])]


# ---------------------------------------------------------------- links of a shard


class Forest:
    """Union of positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def midpoints(prints: np.ndarray, flips: int) -> np.ndarray:
    """Array (variants, prints): each print with up to ``flips`` bits flipped."""
    masks = [0]
    for k in range(1, flips + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    return prints[None, :] ^ np.array(masks, dtype=np.uint64)[:, None]


def link_rows(prints: np.ndarray, rows: np.ndarray, bits: int, forest: Forest) -> None:
    """Links of each row to the later ones that aren't in its tree yet; one step a row, however many links there are."""
    own = prints[rows]
    label = np.array([forest.find(r) for r in rows.tolist()])
    for a in range(len(rows) - 1):
        near = np.bitwise_count(own[a + 1 :] ^ own[a]) <= bits
        near &= label[a + 1 :] != label[a]
        while near.any():
            b = a + 1 + int(near.argmax())
            forest.join(int(rows[a]), int(rows[b]))
            label[label == label[b]] = label[a]
            near &= label[a + 1 :] != label[a]


def _link_dense(prints: np.ndarray, rows: np.ndarray, bits: int, forest: Forest) -> None:
    """Links where no vantage point divides: two prints up to an even number of bits apart have a midpoint at half of
    it, and prints around one midpoint are that near; so neighbours in the order of midpoints join.  For an odd number
    the links of its last bit follow row by row."""
    around = midpoints(np.zeros(1, dtype=np.uint64), bits // 2)[:, 0]
    n = len(rows)
    if len(around) * n <= 20_000_000:
        hubs = (prints[rows][None, :] ^ around[:, None]).ravel()
        order = np.argsort(hubs, kind="stable")
        same = hubs[order][1:] == hubs[order][:-1]
        a, b = order[:-1][same] % n, order[1:][same] % n
        for pair in np.unique(np.minimum(a, b) * n + np.maximum(a, b)).tolist():
            forest.join(int(rows[pair // n]), int(rows[pair % n]))
        if bits % 2 == 0:
            return
    link_rows(prints, rows, bits, forest)


def blocks(prints: np.ndarray, bits: int):
    """Positions, block by block, by a vantage-point tree: any two prints within ``bits`` bits share a block.

    A block of more than SMALL prints is one that no vantage point divides.
    """
    stack = [np.arange(len(prints))]
    while stack:
        rows = stack.pop()
        split = choose_split(prints[rows], bits) if len(rows) > SMALL else None
        if split is None:
            yield rows
            continue
        d = distances(prints[rows], split[0])
        stack += [rows[d <= split[1]], rows[d > split[1] - bits]]


def shard_links(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``prints``, by a vantage-point tree down to small blocks."""
    forest = Forest(len(prints))
    for rows in blocks(prints, bits):
        if len(rows) > SMALL:
            _link_dense(prints, rows, bits, forest)
            continue
        own = prints[rows]
        for start in range(0, len(rows), 128):
            a, b = np.nonzero(np.bitwise_count(own[start : start + 128, None] ^ own[None, start:]) <= bits)
            later = b > a
            if later.sum() > 4 * len(rows):  # a dense block
                link_rows(prints, rows, bits, forest)
                break
            for x, y in zip(rows[start + a[later]].tolist(), rows[start + b[later]].tolist(), strict=True):
                forest.join(x, y)
    return forest.links


def route_fingerprints(nodes: DataFrame, bits: int, sample: int = SAMPLE, shard: int | None = None, shard_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(shard, fp, node) of all shards that ``nodes`` (table int, fp long, node) belong to or reach over a boundary, and
    (shard, n) of the shards of more than ``shard_max``, of which there are fewer than rows over ``shard_max``."""
    spark = nodes.sparkSession
    ship(spark)
    kind = nodes.schema["node"].dataType
    total = nodes.count()
    if shard is None:
        tables = nodes.agg(F.count_distinct("table")).first()[0]
        shard = max(SHARD, SHARD_ROOTS * math.isqrt(total // max(1, tables)))
    shard_max = shard_max or SHARD_OVER * shard
    share = min(1.0, sample / max(1, total))
    # A sample by hash, which is the same in each run; about ``sample`` fingerprints of all tables.
    chosen = nodes.where(F.pmod(F.xxhash64("fp", "table"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("table", "fp").limit(2 * sample).toPandas()
    trees = {}
    for t, part in chosen.groupby("table"):
        prints = part["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        trees[int(t)] = VantageTree(prints, bits, int(shard * min(1.0, len(chosen) / max(1, total))))
    base, offset = {}, 0
    for t in sorted(trees):
        base[t], offset = offset, offset + trees[t].shards
    shared = spark.sparkContext.broadcast((trees, base))
    routed_schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("node", kind)])

    def route(batches):
        trees, base = shared.value
        for batch in batches:
            tables = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            for t in np.unique(tables):
                rows = np.flatnonzero(tables == t)
                tree = trees.get(int(t))
                found = tree.route(prints[rows].view(np.uint64)) if tree else [(0, np.arange(len(rows)))]
                for k, own in found:
                    at = rows[own]
                    shard_ids = np.full(len(at), (base[int(t)] if tree else offset) + k, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard_ids), pa.array(prints[at]), batch.column(2).take(pa.array(at))], names=["shard", "fp", "node"])

    routed = hold(nodes.select("table", "fp", "node").mapInArrow(route, routed_schema), "routed")
    large = hold(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_max).withColumn("parts", F.ceil(2 * F.col("n") / shard_max)), "large")
    return routed, large


def deal_parts(routed: DataFrame, large: DataFrame) -> DataFrame:
    """``routed`` with columns ``i`` and ``j``: those of a large shard dealt into parts, and each row once for each other
    part, so that any two rows share a group (shard, i, j), of bounded size."""
    if not large.limit(1).count():
        return routed.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    # A row a large shard, each of shard_max rows or more: may be broadcast.
    rows = routed.join(F.broadcast(large.select("shard", "parts")), "shard", "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("own"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)))
    return rows.withColumns({"i": F.coalesce(F.least("own", "other"), F.lit(0)), "j": F.coalesce(F.greatest("own", "other"), F.lit(0))}).select(*routed.columns, "i", "j")


def link_fingerprints(nodes: DataFrame, bits: int = MAX_BITS, sample: int = SAMPLE, shard: int | None = None, shard_max: int | None = None) -> DataFrame:
    """Links (a, b) of ``nodes`` (table int, fp long, node), enough to join all within ``bits`` bits in a table.

    (table, fp) has to be distinct.
    """
    routed, large = route_fingerprints(nodes, bits, sample, shard, shard_max)
    kind = nodes.schema["node"].dataType
    link_schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def within(group: pa.Table) -> pa.Table:
        prints = group.column("fp").to_numpy().view(np.uint64)
        links = np.array(shard_links(prints, bits), dtype=np.int64).reshape(-1, 2)
        ids = group.column("node").combine_chunks()
        return pa.table([ids.take(pa.array(links[:, 0])), ids.take(pa.array(links[:, 1]))], names=["a", "b"])

    if not large.limit(1).count():
        return routed.groupBy("shard").applyInArrow(within, link_schema)
    if bits > 2:
        return deal_parts(routed, large).groupBy("shard", "i", "j").applyInArrow(within, link_schema)
    ids = F.broadcast(large.select("shard"))
    links = routed.join(ids, "shard", "left_anti").groupBy("shard").applyInArrow(within, link_schema)
    return links.unionByName(_links_of_large(routed.join(ids, "shard", "left_semi"), bits, link_schema))


def _links_of_large(routed: DataFrame, bits: int, schema: T.StructType) -> DataFrame:
    """Links, up to two bits, of shards that no vantage point divides and that are too large for a task.

    Each print goes to its midpoints within half of ``bits``, and is linked to the first one there.  For one bit each
    also goes to those one bit farther, and is linked to the first of the nearer ones there.
    """
    def spread(flips: int) -> DataFrame:
        masks = midpoints(np.zeros(1, dtype=np.uint64), flips)[:, 0].view(np.int64).tolist()
        rows = routed.select("shard", "fp", "node", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
        return rows.select("shard", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"), "node")

    near, far = spread(bits // 2), spread((bits + 1) // 2)
    firsts = near.groupBy("shard", "hub").agg(F.min("node").alias("first"))
    met = far.join(firsts, ["shard", "hub"]).where(F.col("node") != F.col("first"))
    return met.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().to(schema)


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches, by alternating large and small stars until
    nothing changes."""
    def state(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def star(pairs, large):
        """Each node's neighbours meet its smallest; ``large``: those above the node, else those below."""
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(least, "a")
        if large:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = hold(links.where("a <> b").distinct(), "links")
    before = state(now)
    last = None
    while before != last:
        after = hold(star(star(now, True), False), "stars")
        drop_held(now)
        now, last, before = after, before, state(after)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _components(prints: DataFrame, bits: int, tables: int) -> DataFrame:
    """(fps, node, component, n, first) of the distinct fingerprints of ``prints``; ``first`` is (no_id, id, mark, row)
    of the row with the smallest id, and ``node`` the smallest row number."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "row")).alias("first")
    nodes = hold(prints.groupBy("fps").agg(F.min("row").alias("node"), first), "nodes")
    table = nodes.select(F.posexplode("fps").alias("table", "fp"), "node")
    if tables > 1:
        # Nodes that share a table's print are linked through the first of them.
        firsts = hold(table.groupBy("table", "fp").agg(F.min("node").alias("node")), "firsts")
        equal = table.withColumnRenamed("node", "b").join(firsts.withColumnRenamed("node", "a"), ["table", "fp"]).select("a", "b")
        links = link_fingerprints(firsts, bits).unionByName(equal)
    else:
        links = link_fingerprints(table, bits)
    found = components(links)
    return nodes.join(found, "node", "left").select("fps", "node", F.coalesce("component", "node").alias("component"), "first")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = MAX_BITS, tables: int = 1) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (16 hex digits, of the first table), ``component_id``.

    Rows link where their fingerprints differ in at most ``bits`` bits in one of ``tables`` tables; the component is
    the smallest key reachable, the row's own included.  Texts of fewer than ``size`` words have all their words as
    one shingle; null and wordless texts have the fingerprint zero and link like others; texts are read whole, however
    long.  Rows are linked, not keys: rows that share a key are documents of their own, and rows with a null key link
    like others, but name a component only (by null) where none of its rows has a key.  Other columns are left out,
    whatever their names; an empty table gives no rows.
    """
    prints = with_rows(with_fingerprints(docs, text, key, size, tables), "prints")
    named = hold(_components(prints, bits, tables), "named")
    least = named.groupBy("component").agg(F.min("first.id").alias("component_id"))
    names = named.select(F.col("fps").alias("_fps"), "component").join(least, "component").select("_fps", "component_id")
    # One print may be that of a third of all rows; the other side has one row a print, and AQE splits the large part.
    out = prints.join(names, F.col("fps") == F.col("_fps"), "left")
    digits = F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0"))
    return out.select(F.col("id").alias(key), digits.alias("fingerprint"), "component_id")


def keep_heads(docs: DataFrame, rows: DataFrame, heads: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` with the key and text of one of ``heads`` (id, mark); of those that share both one stays.

    ``rows`` (id, mark) are those of ``docs``; ``mark`` is xxhash64 of the text.
    """
    names = [free_name(docs.columns, n) for n in ("_mark", "_head_id", "_head_mark")]
    heads = heads.select(F.col("id").alias(names[1]), F.col("mark").alias(names[2]))
    marked = docs.withColumn(names[0], F.xxhash64(text))
    same = F.col(names[0]) == F.col(names[2])
    with_key = marked.join(heads.where(F.col(names[1]).isNotNull()), (F.col(key) == F.col(names[1])) & same, "left_semi")
    without = marked.where(F.col(key).isNull()).join(heads.where(F.col(names[1]).isNull()), same, "left_semi")
    if rows.groupBy("id", "mark").count().where("count > 1").limit(1).count():
        with_key, without = with_key.dropDuplicates([key, names[0]]), without.dropDuplicates([names[0]])
    return with_key.unionByName(without).drop(names[0])


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = MAX_BITS, tables: int = 1) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest key, null last; all columns stay.

    Rows are linked as by :func:`near_duplicates`; of rows that share the kept key and text one stays.
    """
    prints = with_rows(with_fingerprints(docs, text, key, size, tables), "prints")
    named = _components(prints, bits, tables)
    heads = named.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.mark")
    return keep_heads(docs, prints, heads, text, key)
