"""Continuous ingestion and alerts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.ingest import ingest, normalise
from kinweave.schemas import RECORD
from kinweave.store import Store, bucket


def read_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of records from JSON-lines files as they arrive."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest_stream(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Take each micro-batch into the store, rewriting only the buckets it touches, in one snapshot.

    Ids come from content, so a batch that is tried again changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        d, _ = normalise(batch)
        touched = [r[0] for r in d.select(bucket(F.col("id"))).distinct().collect()]  # at most BUCKETS
        if touched:
            documents, mentions = ingest(store.read("documents", buckets=touched), store.read("mentions", buckets=touched), batch)
            store.commit({"documents": documents, "mentions": mentions}, {"documents": touched, "mentions": touched})

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contact_counts(contacts: DataFrame, late: str = "2 days", panes: bool = True) -> DataFrame:
    """Contacts of each pair in sliding windows of 90 days, a day apart, as (window, pair, contacts).

    Contacts are first counted by day. A batch then needs no copies: a day's count enters the windows that begin 89 days
    before it and leaves those that begin after it, so a running sum over these two steps gives every window. On a stream,
    which has no such sum, each day's count (not each contact) goes into its 90 windows, and what is later than the
    watermark is left out. Two aggregations in a row can only be written in append mode, a window when it is over;
    without ``panes`` each contact goes into its windows, in one aggregation that any mode can write.
    """
    if contacts.isStreaming and not panes:
        return contacts.withWatermark("at", late).groupBy(F.window("at", "90 days", "1 day").alias("window"), "pair").agg(F.count(F.lit(1)).alias("contacts"))
    if contacts.isStreaming:
        days = contacts.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("day"), "pair").agg(F.count(F.lit(1)).alias("n"))
        return days.groupBy(F.window(F.window_time("day"), "90 days", "1 day").alias("window"), "pair").agg(F.sum("n").alias("contacts"))
    days = contacts.where("at is not null").groupBy("pair", F.window("at", "1 day").start.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    step = lambda later, n: F.struct((F.unix_micros("day") / 86_400_000_000 + later).cast("long").alias("start"), n.alias("n"))
    steps = days.select("pair", F.inline(F.array(step(-89, F.col("n")), step(1, -F.col("n"))))).groupBy("pair", "start").agg(F.sum("n").alias("n"))
    w = W.partitionBy("pair").orderBy("start")
    runs = steps.select("pair", "start", F.sum("n").over(w).alias("contacts"), F.lead("start").over(w).alias("end")).where("contacts > 0")
    each = runs.select("pair", "contacts", F.explode(F.sequence("start", F.col("end") - 1)).alias("d"))
    at = lambda d: F.timestamp_micros(d * 86_400_000_000)
    return each.select(F.struct(at(F.col("d")).alias("start"), at(F.col("d") + 90).alias("end")).alias("window"), "pair", "contacts")


def bursts(contacts: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of contact of each pair."""
    return contacts.withWatermark("at", late).groupBy(F.session_window("at", gap), "pair").agg(F.count(F.lit(1)).alias("contacts"))


def once(records: DataFrame, key: str = "external_id", late: str = "7 days") -> DataFrame:
    """Records whose key didn't come before within the watermark; for sources that send again. ``at`` is their event time."""
    return records.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
