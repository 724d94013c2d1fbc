"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target of words, so each of its documents an expected number of copies; the whole part of it is
taken, the fraction is an inclusion probability.  The flight moves the fractions of three documents at a time along
the null space of (one document, its words), which keeps the totals of documents and words, until all but two of a
chunk are 0 or 1; what is left of the chunks flies on together, and the last few land by least error.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, hold, raw, ship, tidy

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents that fly together.
CHUNK = 2048
TINY = 1e-9
#: Rows that one array of :func:`repeated` stands for, at most.
STEP = 10_000


def word_count(texts) -> list[int]:
    return [len((t or b"").split()) for t in texts]


def with_sizes(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """(id, source, mark, size): a hash of the text, and words between ASCII white space; null has none."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("source", docs.schema[source].dataType), T.StructField("mark", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(word_count(raw(batch.column(3))), pa.int64())], names=schema.names)

    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, schema)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target): shares of ``share`` times all sizes by weight.

    Sources by code point, null last, have the weights in turn.  A target stops at ``most`` times its source's size;
    the excess goes to the others by weight until none is above.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    # The rank over all sources without bringing them together: parts in order, and where each part starts.
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = hold(ordered, "sources")
    begin, starts = 0, []
    for row in ordered.groupBy("part").count().orderBy("part").collect():
        starts.append((row["part"], begin))
        begin += row["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("part")) if starts else F.lit(0)
    ranked = ordered.withColumn("place", place + offset)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = hold(ranked.select("source", "n_docs", "source_size", weight.alias("weight")), "ranked")
    most_of = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while total:
        full = most_of <= F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(full, most_of).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        if row["n"] == before or not row["w"]:
            break
        before, level = row["n"], (share * total - row["used"]) / row["w"]
    return ranked.select("source", "n_docs", "source_size", F.least(most_of, F.col("weight") * F.lit(level)).alias("target"))


def fly(sizes: list[int], chances: list[float], rng: random.Random) -> list[float]:
    """Chances moved to 0 or 1 but for two at most, with the same totals of chances and of chance times size."""
    out, window = list(chances), []
    for k in range(len(out)):
        if not TINY < out[k] < 1 - TINY:
            out[k] = float(round(out[k]))
            continue
        window.append(k)
        while len(window) == 3:
            a, b, c = window
            step = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if step == (0, 0, 0):
                step = (1, -1, 0)
            up = min((1 - out[i]) / s if s > 0 else out[i] / -s for i, s in zip(window, step, strict=True) if s)
            down = min(out[i] / s if s > 0 else (1 - out[i]) / -s for i, s in zip(window, step, strict=True) if s)
            move = up if rng.random() * (up + down) < down else -down
            left = []
            for i, s in zip(window, step, strict=True):
                out[i] += move * s
                if TINY < out[i] < 1 - TINY:
                    left.append(i)
                else:
                    out[i] = float(round(out[i]))
            if len(left) == 3:  # rounding alone kept the nearest from its end
                near = min(left, key=lambda i: min(out[i], 1 - out[i]))
                out[near] = float(round(out[near]))
                left.remove(near)
            window = left
    return out


def land(sizes: list[int], chances: list[float], flown: list[float]) -> list[float]:
    """The last fractions to the ends that miss the words least; what error is left is made good by small documents."""
    out = list(flown)
    open_ = [k for k, p in enumerate(out) if 0 < p < 1]
    aim = sum(p * n for p, n in zip(chances, sizes, strict=True))
    base = sum(out[k] * sizes[k] for k in range(len(out)) if k not in open_)
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda ends: (abs(base + sum(e * sizes[k] for e, k in zip(ends, open_, strict=True)) - aim), ends))
    for k, end in zip(open_, best, strict=True):
        out[k] = end
    error = sum(p * n for p, n in zip(out, sizes, strict=True)) - aim
    for k in sorted((k for k in range(len(out)) if 0 < chances[k] < 1), key=lambda k: -sizes[k]):
        change = sizes[k] if out[k] == 0 else -sizes[k]
        if abs(error + change) < abs(error):
            out[k], error = 1 - out[k], error + change
    return out


def mix_units(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """(id, source, mark, size, n, source_size, target, copies) of rows (id, source, mark, size); see :func:`mix`.

    The ``n`` rows that are alike in all four are one unit, whose ``copies`` are those of all of them, so that nothing
    depends on the order of rows and no chunk gathers what hashes can't tell apart.
    """
    named = targets(sized, weights, share, most)
    units = sized.groupBy("id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n"))
    # Sources are few against documents; where they aren't, Spark joins by shuffle and splits hot ones.
    t = named.select(F.col("source").alias("_s"), "source_size", "target")
    factor = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("factor", factor)
    rows = rows.select("id", "source", "mark", "size", "n", "source_size", "target", F.floor("factor").cast("long").alias("whole"), (F.col("factor") - F.floor("factor")).alias("chance"))
    rows = hold(rows, "chances")
    open_ = f"chance > {TINY} and chance < {1 - TINY}"
    done = [rows.where(f"not ({open_})").withColumn("chance", F.round("chance"))]
    left = rows.where(open_)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in left.schema.fields])
    chunk, level = max(8, chunk), 0  # a chunk leaves two at most, so each level has a fraction of the one before
    while left.limit(1).count():
        counts = left.groupBy("source").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / chunk)).cast("long").alias("chunks")).withColumnRenamed("source", "_s")
        dealt = left.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), "id", "mark", "size"), F.col("chunks")))

        def move(group: pa.Table) -> pa.Table:
            order = np.lexsort((group.column("mark").to_numpy(), np.array([str(x) for x in group.column("id").to_pylist()]), -group.column("size").to_numpy()))
            group = group.take(pa.array(order))
            sizes, chances = group.column("size").to_pylist(), group.column("chance").to_pylist()
            rng = random.Random(f"{group.column('source')[0].as_py()}/{group.column('chunk')[0].as_py()}/{level}")
            out = fly(sizes, chances, rng)
            if group.column("chunks")[0].as_py() == 1:
                out = land(sizes, chances, out)
            at = group.column_names.index("chance")
            return group.set_column(at, "chance", pa.array(out, pa.float64())).select(schema.names)

        flown = hold(dealt.groupBy("source", "chunk").applyInArrow(move, schema), "flown")
        done.append(flown.where("chance = 0 or chance = 1"))
        left, level = flown.where("chance > 0 and chance < 1"), level + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select("id", "source", "mark", "size", "n", "source_size", "target", (F.col("whole") + F.col("chance")).cast("long").alias("copies"))


def repeated(df: DataFrame, times: Column, name: str) -> DataFrame:
    """``df`` with each row ``times`` times, numbered from 0 in column ``name``; the arrays behind it are bounded."""
    many = F.floor((times - 1) / STEP)
    df = df.where(times > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), many)))
    first = F.col(name) * STEP
    return df.withColumn(name, F.explode(F.sequence(first, F.least(times - 1, first + STEP - 1))))


def mix_plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """For each row its id, source, size, source_size, target and copies; reruns agree, whatever the partitions.

    Words are runs without ASCII white space; null has none, and a document without words is taken or left like
    others, at no words; texts are read whole.  A null source is one source, the last by order.  Sources without words
    have the target 0.  Repeated rows and null keys are documents of their own; rows alike in key, source and text share
    their copies evenly.  An empty table gives an empty result.
    """
    units = mix_units(hold(with_sizes(docs, text, key, source), "sizes"), **options)
    rows = repeated(units, F.col("n"), "place")
    extra = (F.col("place") < F.col("copies") % F.col("n")).cast("long")
    return rows.select("id", "source", "size", "source_size", "target", (F.floor(F.col("copies") / F.col("n")) + extra).alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies (see :func:`mix_plan`), all columns as they were.

    Where rows alike in key, source and text don't share their copies evenly, one of them has those that are over.
    """
    names = [free_name(docs.columns, n) for n in ("_mark", "_id", "_source", "_text_mark", "_all", "_over", "_place")]
    mark, id_, source_, text_mark, all_, over, place = names
    with tidy(docs.sparkSession) as keep:
        units = mix_units(hold(with_sizes(docs, text, key, source), "sizes"), **options)
        taken = units.select(F.col("id").alias(id_), F.col("source").alias(source_), F.col("mark").alias(text_mark), F.floor(F.col("copies") / F.col("n")).alias(all_), (F.col("copies") % F.col("n")).alias(over))
        taken = keep(taken.where(f"{all_} > 0 or {over} > 0"), "taken")
    same = F.col(key).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(source_)) & (F.col(mark) == F.col(text_mark))
    met = docs.withColumn(mark, F.xxhash64(text)).join(taken, same)
    out = repeated(met, F.col(all_), place).select(*docs.columns)
    if taken.where(f"{over} > 0").limit(1).count():
        ones = docs.withColumn(mark, F.xxhash64(text)).join(taken.where(f"{over} > 0"), same).dropDuplicates([id_, source_, text_mark])
        out = out.unionByName(repeated(ones, F.col(over), place).select(*docs.columns))
    return out
