"""Joins and rankings that keep tables right: latest rows, parity, renames, audits, paging, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import batches_in_order, last_before, numbered


def latest_per_key(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key, ties by the larger ``tie``.

    An aggregate over one struct, so rows are combined before the shuffle and a
    hot key costs no sort.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(ts, tie, *[c for c in rest if c not in (ts, tie)])).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def row_hash(columns: list[str]) -> Column:
    """MD5 of a row's values as sorted JSON; nulls keep their place."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def hash_audit(local: DataFrame, remote: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose row is missing or different at the other side, with the reason."""
    here = local.select(key, row_hash(columns).alias("here"))
    there = remote.select(key, row_hash(columns).alias("there"))
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("here") != F.col("there"), "mismatch")
    return here.join(there, key, "left").withColumn("reason", reason).where("reason is not null").select(key, "reason")


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` from the right, or ``extra`` there."""
    missing = left.select(key).join(right.select(key), key, "left_anti").withColumn("status", F.lit("missing"))
    extra = right.select(key).join(left.select(key), key, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def count_delta(left: DataFrame, right: DataFrame, label: str = "label", value: str = "n") -> DataFrame:
    """Labelled counts of two sides next to each other; an absent label counts 0."""
    both = left.select(label, F.col(value).alias("local")).join(right.select(label, F.col(value).alias("remote")), label, "full_outer")
    filled = both.select(label, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("local", "remote")])
    return filled.withColumn("delta", F.col("local") - F.col("remote"))


def classify_files(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Each scanned (``path``, ``checksum``) as unchanged, updated, renamed or new, with the path it had.

    The path decides first; else a known file of the same checksum is a rename.
    """
    by_path = known.select("path", F.col("checksum").alias("old_checksum"))
    by_sum = known.groupBy("checksum").agg(F.min("path").alias("old_path"))
    status = (
        F.when(F.col("old_checksum").eqNullSafe(F.col("checksum")), "unchanged")
        .when(F.col("old_checksum").isNotNull(), "updated")
        .when(F.col("old_path").isNotNull(), "renamed").otherwise("new")
    )
    joined = scanned.join(by_path, "path", "left").join(by_sum, "checksum", "left").withColumn("status", status)
    return joined.select("path", "checksum", "status", F.when(F.col("status") == "renamed", F.col("old_path")).alias("old_path"))


def keyset_page(rows: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after the cursor (``ts``, ``key``), in that order.

    The plain bound on ``ts`` repeats what the pair says, in a form that reaches
    the file scan.
    """
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(ts) >= at) & ((F.col(ts) > at) | (F.col(key) > last)))
    return rows.orderBy(ts, key).limit(limit)


def text_keyset_page(rows: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a text key."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def offset_page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def pack_batches(rows: DataFrame, order: str, bytes_col: str, group: str, max_rows: int = 25, max_bytes: int = 2 << 20) -> DataFrame:
    """Rows with their ``batch``, greedily filled in order within each group, up to either limit.

    A row over the byte limit has a batch to itself. Batches restart with every
    group, such as a table or device; a group of any size is dealt over tasks.
    """
    return batches_in_order(rows, order, bytes_col, group, max_rows, max_bytes)


def logical_clock(events: DataFrame, device: str, ts: str, key: str) -> DataFrame:
    """Events with ``logical_time``, counted from 1 on each device; a device's events are counted by ranges, side by side."""
    return numbered(events, [device], [ts, key], "logical_time")


def attach_to_preceding(records: DataFrame, order: str, is_head: Column, value: str, within: str | None = None) -> DataFrame:
    """Rows with ``head``: the ``value`` of the nearest head row at or before them."""
    return last_before(records, [within] if within else [], order, F.when(is_head, F.col(value)), "head")


def recent(rows: DataFrame, ts: str, key: str, limit: int, where: Column | None = None) -> DataFrame:
    """The newest ``limit`` rows, ties by the smaller key."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(ts), key).limit(limit)
