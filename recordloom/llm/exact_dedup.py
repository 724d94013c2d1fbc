"""Exact dedup in two passes over a Bloom filter, in DataFrame functions only.

Pass one counts, for each of ``HASHES`` cells a text hash falls into, how many rows hit it (saturating at two), and
packs the cells hit twice into bitmaps.  Pass two tests every row against these bitmaps: a row with a cell that was
hit once has no equal, and goes straight through; only the others are shuffled by their digest.

A filter has a fixed largest size (``max_bits``), which bounds what is broadcast.  Rows beyond what one filter holds at
BITS_PER_ROW are dealt into blocks by hash, each with a filter of its own, so that as few rows shuffle at any size.
Pass one shuffles two cell numbers a row, pre-aggregated; texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, hold, scratch

#: Bits of one bitmap of Spark's bitmap functions (4 KiB).
BITMAP_BITS = 32768
HASHES = 2
#: 2**29 bits are 64 MiB of bitmaps at most.
MAX_BITS = 1 << 29
BITS_PER_ROW = 16
LARGE_GROUPS = 1000


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Power of two of at least BITS_PER_ROW bits a row, within one bitmap and ``max_bits``."""
    bits = BITMAP_BITS
    while bits < rows * BITS_PER_ROW and bits < max_bits:
        bits *= 2
    return bits


def _cells(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), digest), F.lit(bits)) for k in range(HASHES)]


def _bit(bitmap: Column, position: Column) -> Column:
    """Whether bit ``position`` (from 0, low bit of each byte first) of a binary column is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (position % 8).cast("int") + 1)
    return byte.bitwiseAND(mask) != 0


def possible_repeats(rows: DataFrame, digest: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with a boolean column ``maybe``: false only where no other row has the same ``digest``.

    One filter of ``max_bits`` bits at most; see :func:`marked` for more rows than it holds.
    """
    bits = filter_bits(rows.count(), max_bits)
    hit = rows.select(F.explode(F.array(*_cells(F.col(digest), bits))).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bitmaps = twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap")
    )
    bitmaps = hold(bitmaps, "bloom")
    out = rows
    flags = []
    for k, cell in enumerate(_cells(F.col(digest), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_b{k}"), F.col("bitmap").alias(f"_m{k}"))
        # bits / 8 bytes at most, whatever the input: safe to broadcast.
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(cell) == F.col(f"_b{k}"), "left")
        flags.append(F.coalesce(_bit(F.col(f"_m{k}"), F.bitmap_bit_position(cell)), F.lit(False)))
    return out.select(*[rows[c] for c in rows.columns], reduce(Column.__and__, flags).alias("maybe"))


def marked(rows: DataFrame, digest: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with the column ``maybe`` of :func:`possible_repeats`, written, with filters of BITS_PER_ROW bits a row."""
    blocks = -(-rows.count() * BITS_PER_ROW // max_bits)
    if blocks <= 1:
        return hold(possible_repeats(rows, digest, max_bits), "marked")
    spark = rows.sparkSession
    dealt, out = scratch(spark, "blocks"), scratch(spark, "marked")
    block = free_name(rows.columns, "_block")
    rows.withColumn(block, F.pmod(F.xxhash64(F.lit("block"), digest), F.lit(blocks))).write.partitionBy(block).parquet(dealt)
    parts = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(block, T.LongType())])).parquet(dealt)
    for k in range(blocks):
        own = possible_repeats(parts.where(F.col(block) == k).drop(block), digest, max_bits)
        own.write.mode("append").parquet(out)
    return spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())])).parquet(out)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are the same without ASCII white space; null counts as the empty text.  Of equal texts
    the row with the most code points in the original text stays, then the smallest key, null keys last; of rows that
    tie in all of these, one stays.  Texts are read whole, however long.  Other columns are left out, whatever their names; an empty table gives an empty
    result.
    """
    digests = hold(
        docs.select(
            F.col(key).alias("id"),
            F.sha2(normalised(F.col(text)), 256).alias("sha"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    tested = marked(digests, "sha", max_bits)
    single = tested.where(~F.col("maybe")).select(
        F.col("id").alias(key), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    several = tested.where("maybe")
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id"), F.col("row"))
    groups = hold(several.groupBy("sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).withColumnRenamed("sha", "_sha"), "groups")
    # Groups of over a thousandth of these rows are under a thousand, so they may be broadcast, and their rows don't
    # gather in a task; the others meet by a shuffle.
    large = F.broadcast(groups.where(F.col("size") * LARGE_GROUPS > several.count()))
    same = F.col("sha") == F.col("_sha")
    met = several.join(large, same).unionByName(several.join(large.select("_sha"), same, "left_anti").join(groups, same))
    repeated = met.select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return single.unionByName(repeated)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that :func:`exact_dedup` keeps; all columns stay.

    Of rows that tie in text, length and key, one stays.
    """
    names = [free_name(docs.columns, n) for n in ("_sha", "_chars", "_kept_sha", "_kept_id")]
    kept = exact_dedup(docs, text, key).where("kept").select(F.col("text_sha256").alias(names[2]), F.col("keep_id").alias(names[3]))
    own = docs.withColumns({names[0]: F.sha2(normalised(F.col(text)), 256), names[1]: F.char_length(F.coalesce(F.col(text), F.lit("")))})
    met = own.join(kept, (F.col(names[0]) == F.col(names[2])) & F.col(key).eqNullSafe(F.col(names[3])))
    longest = met.groupBy(names[0]).agg(F.max(names[1]).alias(names[1]))
    return met.join(longest, [names[0], names[1]], "left_semi").dropDuplicates([names[0]]).select(*docs.columns)
