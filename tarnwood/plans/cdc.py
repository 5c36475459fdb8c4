"""Change capture between snapshots, publication, and idempotent application elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.upkeep import keyset_page, row_hash

DERIVED = ("embedding", "fts")
#: Long texts leave with active rows only.
BULKY = ("content", "goal", "summary")


def payload(columns: list[str], active: Column) -> Column:
    """A row's JSON image with sorted keys, without derived columns, and without bulky ones unless active."""
    slim = [c for c in sorted(columns) if c not in DERIVED]
    lean = [c for c in slim if c not in BULKY]
    return F.when(active, F.to_json(F.struct(*slim))).otherwise(F.to_json(F.struct(*lean)))


def changes(old: DataFrame, new: DataFrame, key: str, *, ignore: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """(``record_key``, ``operation``, ``payload``, ``payload_checksum``) between two snapshots.

    A row that is gone is a delete, one that is not of the active tier an
    archive, any other new or changed row an upsert; differences in ``ignore``
    alone are none.
    """
    tier = F.col("storage_tier") if "storage_tier" in new.columns else F.lit("active")
    watched = [c for c in new.columns if c not in ignore]
    before = old.select(key, row_hash(watched).alias("was"))
    now = new.select(key, row_hash(watched).alias("is"), payload(new.columns, tier == "active").alias("payload"), (tier != "active").alias("inactive"))
    both = before.join(now, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))
    operation = F.when(F.col("is").isNull(), "delete").when(F.col("inactive"), "archive").otherwise("upsert")
    return both.select(
        F.col(key).cast("string").alias("record_key"), operation.alias("operation"), "payload", F.md5(F.coalesce("payload", F.lit(""))).alias("payload_checksum")
    )


def publish(events: DataFrame, remote: DataFrame, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(events to insert at the remote, ids to mark as published): the oldest unpublished ones, in order."""
    page = events.where("pushed_at is null").orderBy("created_at", "event_id").limit(limit)
    return page.join(remote.select("event_id"), "event_id", "left_anti"), page.select("event_id")


def pull(remote: DataFrame, known: DataFrame, after: tuple | None, limit: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events to record, upserts to apply, the new cursor) after a cursor of (time, id)."""
    page = keyset_page(remote, "created_at", "event_id", after, limit)
    fresh = page.join(known.select("event_id"), "event_id", "left_anti").select(*remote.columns)
    cursor = page.agg(F.max(F.struct("created_at", "event_id")).alias("c")).select("c.created_at", "c.event_id")
    return fresh, fresh.where("operation = 'upsert'"), cursor


def latest_payloads(events: DataFrame) -> DataFrame:
    """The last event of each record, deletes included: what state the log leads to."""
    last = events.groupBy("table_name", "record_key").agg(F.max_by(F.struct("operation", "payload"), F.struct("created_at", "event_id")).alias("e"))
    return last.select("table_name", "record_key", "e.operation", "e.payload")


def applied(state: DataFrame, events: DataFrame, *, deletes: bool = False) -> DataFrame:
    """State (``table_name``, ``record_key``, ``payload``) after a batch of events; twice is the same as once."""
    last = latest_payloads(events if deletes else events.where("operation = 'upsert'"))
    kept = state.join(last.select("table_name", "record_key"), ["table_name", "record_key"], "left_anti")
    return kept.select("table_name", "record_key", "payload").unionByName(last.where("operation = 'upsert'").select("table_name", "record_key", "payload"))


def baseline(rows: DataFrame, events: DataFrame, key: str, table: str) -> DataFrame:
    """Rows that no upsert event of ``table`` names."""
    named = events.where((F.col("table_name") == table) & (F.col("operation") == "upsert")).select(F.col("record_key").alias("k"))
    return rows.join(named, F.col(key).cast("string") == F.col("k"), "left_anti")


def drained(queue: DataFrame, order: list[str]) -> DataFrame:
    """Queue rows with their ``turn``: deletes from children to parents, then upserts from parents to children."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("table_name")).cast("int")
    turn = F.when(F.col("operation") == "delete", F.lit(len(order)) - place).otherwise(F.lit(len(order)) + place)
    return queue.withColumn("turn", turn)


def interrupted_runs(runs: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Runs that still say running though they started longer ago than they may take."""
    return runs.where((F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")))


def cache_payloads(manifest: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """A derived cache built anew: each manifest entry (``source_table``, ``source_id``) with the row it names.

    The constant of each side is part of its join, so an entry meets one table only.
    """
    out = None
    for name, rows in sides.items():
        part = manifest.where(F.col("source_table") == name).join(rows.select(F.col("id").alias("source_id"), "payload"), "source_id", "left")
        out = part if out is None else out.unionByName(part)
    return out.select("source_table", "source_id", "payload")


def ledger(progress: DataFrame) -> DataFrame:
    """Runs with their last state: (``run_id``, ``status``, ``rows``)."""
    last = progress.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.sum("rows").alias("rows"))
    return last.select("run_id", "status", "rows")
