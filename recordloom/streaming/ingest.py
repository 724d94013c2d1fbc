"""Tracks kept up to date from a stream of file listings, with the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import scan
from ..sources.store import Snapshots

LISTING = "path string, length long, modificationTime timestamp"


def merge_listing(known: DataFrame | None, listing: DataFrame) -> DataFrame:
    """``known`` tracks and those of a listing that aren't among them; these come after all others in ``ord``."""
    latest = listing.groupBy("path").agg(F.max("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    last = None if known is None else known.agg(F.max("ord")).first()[0]
    fresh = scan(latest, known).withColumn("ord", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1).cast("long"))
    return fresh if known is None else known.unionByName(fresh, allowMissingColumns=True)


def follow(spark: SparkSession, listings: str, store: str, checkpoint: str) -> StreamingQuery:
    """Take in listings (JSON lines) that come into a folder, one snapshot a batch; ends when all there are is in.

    A batch that is run again after a failure finds its tracks already known, and changes nothing.
    """
    snapshots = Snapshots(spark, store)
    stream = spark.readStream.schema(LISTING).json(listings)

    def take(batch: DataFrame, _: int) -> None:
        snapshots.commit(merge_listing(snapshots.read(), batch))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
