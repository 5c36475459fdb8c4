"""Streams over change events; each is a plan that runs the same on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cdc
from ..plans.store import Store


def memories_from_events(events: DataFrame) -> DataFrame:
    """Posted events as memories: trimmed summary and details, importance 0.7, tagged by type."""
    text = F.trim(F.concat(F.coalesce("summary", F.lit("")), F.lit("\n\n"), F.coalesce("details", F.lit(""))))
    kind = F.coalesce("event_type", F.lit("task_complete"))
    return events.select("event_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("content"), F.lit(0.7).alias("importance"), F.array(kind).alias("tags"), "ts")


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within ``delay``; state older than that is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """An extension: events by type in windows of event time, late ones within ``delay`` included."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def apply_stream(events: DataFrame, store: Store, name: str, checkpoint: str, *, deletes: bool = False):
    """Apply a stream of change events to a stored state, batch by batch, until what is there is done.

    A batch that is run again leads to the same state, so a restart after a
    failure neither loses nor repeats a change.
    """

    def one(batch: DataFrame, _: int) -> None:
        none = batch.select("table_name", "record_key", "payload").limit(0)
        store.replace(name, lambda state: cdc.applied(none if state is None else state, batch, deletes=deletes))

    query = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read(name)
