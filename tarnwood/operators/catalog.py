"""Operational aggregates: counts, coverage, storage, events, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(``label``, ``n``) for each table, counted from file footers where possible."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in tables.items()])


def dimensions(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dimension")).agg(F.count("*").alias("n"))


def storage_catalog(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(``category``, ``storage_tier``): rows and bytes, partial sums before the union's shuffle."""
    parts = [
        df.groupBy("storage_tier").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).withColumn("category", F.lit(name))
        for name, (df, size) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("category", "storage_tier", "n", "bytes")


def embedding_coverage(tables: dict[str, DataFrame], dimension: int, vector: str = "embedding") -> DataFrame:
    """Per table and in all: rows, vectors missing, vectors of another dimension, and a status."""
    one = lambda name, df: df.agg(
        F.count("*").alias("total"), F.count_if(F.col(vector).isNull()).alias("missing"),
        F.count_if(F.col(vector).isNotNull() & (F.size(vector) != dimension)).alias("wrong_dimension"),
    ).select(F.lit(name).alias("label"), "total", "missing", "wrong_dimension")
    parts = reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
    whole = parts.agg(*[F.sum(c).alias(c) for c in ("total", "missing", "wrong_dimension")]).select(F.lit("all").alias("label"), "total", "missing", "wrong_dimension")
    status = F.when((F.col("missing") == 0) & (F.col("wrong_dimension") == 0), "complete").otherwise("repair")
    return parts.unionByName(whole).withColumn("status", status)


def event_totals(events: DataFrame, published: Column, size: Column) -> DataFrame:
    """Events in all, published, still to publish, and the bytes of those."""
    return events.agg(
        F.count("*").alias("total"), F.count_if(published).alias("published"), F.count_if(~published).alias("unpublished"),
        F.coalesce(F.sum(F.when(~published, size)), F.lit(0)).alias("pending_bytes"),
    )


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merged_reports(reports: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Reports of parts summed by key."""
    return reports.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


def outbox(changes: DataFrame, keys: list[str], op: str, ts: str, tie: str) -> DataFrame:
    """One row for each changed key: how often it changed, and the last operation; an archive leaves the mirror as a delete."""
    last = F.max_by(op, F.struct(ts, tie))
    rows = changes.groupBy(*keys).agg(F.count("*").alias("generation"), last.alias("operation"), F.max(ts).alias("changed_at"))
    return rows.withColumn("operation", F.when(F.col("operation") == "archive", "delete").otherwise(F.col("operation")))


def acknowledged(queue: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """What stays queued: rows that changed again after the generation that was sent."""
    return queue.join(acks.select(*keys, "generation").distinct(), [*keys, "generation"], "left_anti").select(*queue.columns)




def tier_report(rows: DataFrame, bundles: DataFrame, queue: DataFrame, last: int = 10) -> dict[str, DataFrame]:
    """Rows by tier, the newest bundles, and the depth of the queue."""
    return {
        "tiers": rows.groupBy("storage_tier").agg(F.count("*").alias("n")),
        "bundles": bundles.orderBy(F.desc("created_at"), "bundle_id").limit(last),
        "queue": queue.agg(F.count("*").alias("depth")),
    }


def health(healthy: bool, embedder: bool, migrations: DataFrame, queue: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: retrieval mode, schema version, queue depth, and how many vector dimensions there are.

    More than one dimension switches semantic search off, which the mode says.
    """
    from ..functions.texts import retrieval_mode

    version = migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("schema_version"))
    depth = queue.agg(F.count("*").alias("queue_depth"))
    dims = vectors.where("embedding is not null").agg(F.count_distinct(F.size("embedding")).alias("dimensions"))
    whole = version.crossJoin(depth).crossJoin(dims)  # one row each
    return whole.withColumn("mode", retrieval_mode(F.lit(healthy), F.lit(embedder) & (F.col("dimensions") <= 1)))


def backlog(local: DataFrame, remote: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts of either side by table (``label``, ``n``), and what of each still waits."""
    from .upkeep import count_delta

    waiting = queue.groupBy(F.col("table_name").alias("label")).agg(F.count("*").alias("queued"))
    return count_delta(local, remote).join(waiting, "label", "left").withColumn("queued", F.coalesce("queued", F.lit(0)))
