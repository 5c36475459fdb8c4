"""Tables as versioned sets of folders, and the row changes that need more than an append.

Plain Parquet cannot be merged into, so a change is a new version: old and new
rows meet in a full outer join on the key and the result goes to a new folder.
An append writes its own rows only. A version is one small file that lists the
table's folders; it is created only if no other writer took its number, so of
two writers one tries again on top of the other: an append adds to the newer
list, a change made of old rows is made anew of the newer ones. Readers of an
old version are never disturbed, and a failed write leaves no version behind.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 13


class Store:
    """Named tables under one root folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, *, most_parts: int = 64):
        """``most_parts``: an append to a table of so many folders rewrites it as one."""
        self.spark, self.root, self.most_parts = spark, root.rstrip("/"), most_parts
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> dict[int, int]:
        """Number and length of each version's file; one of length 0 is being written, or its writer failed."""
        log = self._at(f"{self.root}/{name}/_versions")
        return {int(s.getPath().getName()): s.getLen() for s in self._fs.listStatus(log) if s.getPath().getName().isdigit()} if self._fs.exists(log) else {}

    def _versions(self, name: str) -> list[int]:
        return sorted(v for v, length in self._listed(name).items() if length)

    def _folders(self, name: str, version: int) -> list[str]:
        return [r["value"] for r in self.spark.read.text(f"{self.root}/{name}/_versions/{version:012d}").collect()]

    def _commit(self, name: str, folders: Callable[[int | None], list[str] | None], patience: float = 5.0) -> bool:
        """The next version, of the folders that ``folders`` gives for the current one; again if another writer was first.

        None in place of folders gives up, as what was written does not follow from the current version. A version that stays empty for ``patience`` seconds is a failed writer's and is passed over.
        """
        waited = 0.0
        while True:
            listed = self._listed(name)
            newest = max(listed, default=-1)
            if newest >= 0 and not listed[newest] and waited < patience:
                time.sleep(0.1)
                waited += 0.1
                continue
            now = folders(max((v for v, length in listed.items() if length), default=None))
            if now is None:
                return False
            text = "\n".join(now)
            try:
                out = self._fs.create(self._at(f"{self.root}/{name}/_versions/{newest + 1:012d}"), False)
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                waited = 0.0
                continue
            out.write(bytearray(text.encode()))
            out.close()
            return True

    def _written(self, name: str, rows: DataFrame) -> str:
        folder = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for."""
        return self.spark.read.parquet(*self._folders(name, self._versions(name)[-1] if version is None else version))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def version(self, name: str) -> int | None:
        """The number of the newest version."""
        return max(self._versions(name), default=None)

    def write(self, name: str, rows: DataFrame) -> None:
        """Make ``rows`` the table's next version."""
        folder = self._written(name, rows)
        self._commit(name, lambda _: [folder])

    def replace(self, name: str, change: Callable[[DataFrame | None], DataFrame]) -> None:
        """Make what ``change`` gives for the table (None if there is none) its next version; again if another writer was first."""
        while True:
            last = max(self._versions(name), default=None)
            folder = self._written(name, change(None if last is None else self.read(name, last)))
            if self._commit(name, lambda now: [folder] if now == last else None):  # noqa: B023
                return
            self._fs.delete(self._at(folder), True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add ``rows``; what is there stays as it is, until the table has ``most_parts`` folders."""
        versions = self._versions(name)
        if versions and len(self._folders(name, versions[-1])) >= self.most_parts:
            self.replace(name, lambda old: rows if old is None else old.unionByName(rows))
            return
        folder = self._written(name, rows)
        self._commit(name, lambda last: ([] if last is None else self._folders(name, last)) + [folder])

    def upsert(self, name: str, rows: DataFrame, keys: list[str], **how) -> None:
        self.replace(name, lambda old: rows if old is None else merged(old, rows, keys, **how))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and the folders that none of these lists; no writer may be at work."""
        versions = self._versions(name)
        used = {f.rsplit("/", 1)[-1] for v in versions[-keep:] for f in self._folders(name, v)}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.root}/{name}/_versions/{v:012d}"), False)
        for s in self._fs.listStatus(self._at(f"{self.root}/{name}")):
            if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)


def merged(old: DataFrame, new: DataFrame, keys: list[str], *, update: dict[str, str] | None = None) -> DataFrame:
    """``old`` with ``new`` merged in by ``keys``.

    ``update`` says per column what a match does: ``new`` (the default), ``old``,
    or ``filled`` (the new value unless it is null). New keys come in as they are.
    """
    update = update or {}
    o, n = (df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(x)) for df, x in ((old, "o"), (new, "n")))
    both = o.join(n, keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        how = update.get(c, "new") if c in new.columns else "old"
        matched = {"new": now, "old": was, "filled": F.coalesce(now, was)}[how]
        columns.append(F.when(F.col("n").isNull(), was).when(F.col("o").isNull(), now).otherwise(matched).alias(c))
    return both.select(*columns)


def cached(puts: DataFrame, now: Column) -> DataFrame:
    """(``key``, ``value``) of a cache as of ``now``: the last of the ``puts`` (``key``, ``value``, ``put_at``, ``turn``, ``ttl`` seconds) of each key.

    A put of null deletes the key, and one whose time to live is over has no value any more.
    """
    last = puts.groupBy("key").agg(F.max_by(F.struct("value", "put_at", "ttl"), F.struct("put_at", "turn")).alias("r")).select("key", "r.*")
    until = F.timestamp_add("SECOND", F.col("ttl").cast("int"), F.col("put_at"))
    return last.where(F.col("value").isNotNull() & (until > now)).select("key", "value")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def archived(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go to the archive)."""
    return without(rows, gone, keys), rows.join(gone.select(*keys).distinct(), keys, "left_semi").select(*rows.columns)


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with the values of those that match replaced."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def forgotten(rows: DataFrame, where: Column) -> DataFrame:
    """Soft delete: importance 0 and the tag ``forgotten``, once."""
    return updated(rows, where, {"importance": F.lit(0.0), "tags": F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("forgotten")))})


def marked_critical(rows: DataFrame, where: Column) -> DataFrame:
    """Importance of 0.9 at least and the tag ``critical``, once."""
    return updated(rows, where, {"importance": F.greatest("importance", F.lit(0.9)), "tags": F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("critical")))})


def with_accesses(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and last times from an access log (``id``, ``accessed_at``), added to those that rows have."""
    seen = log.groupBy("id").agg(F.count("*").alias("more"), F.max("accessed_at").alias("seen"))
    out = rows.join(seen, "id", "left")
    out = out.withColumn("access_count", F.col("access_count") + F.coalesce("more", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "seen"))
    return out.select(*rows.columns)


def repaired_embeddings(rows: DataFrame, text: Column, embed) -> DataFrame:
    """Missing vectors computed from ``text``; rows that have one pass through."""
    done = rows.where("embedding is not null")
    return done.unionByName(rows.where("embedding is null").withColumn("embedding", embed(text)))


def deduplicated(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def bundle(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines in key order, and a manifest row with their count, bytes and a digest of all rows.

    The digest is that of the sums of the rows' own digests, in four parts: it
    does not depend on their order and is added up before it is shuffled.
    """
    lines = rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    hashed = lines.withColumn("d", F.sha2("value", 256))
    sums = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    manifest = hashed.agg(F.count("*").alias("records"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sha2(F.concat_ws(",", *sums), 256).alias("sha256"))
    return lines.orderBy(key).select("value"), manifest


def restored(archive: DataFrame, bundles: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` archived records of verified bundles, oldest first, active again."""
    good = archive.join(bundles.where("state = 'verified'").select("bundle_id"), "bundle_id")
    return good.orderBy("archived_at", "id").limit(limit).withColumn("storage_tier", F.lit("active"))


def maintained(rows: DataFrame, changed: Column, as_of: Column, explicit: Column | None = None) -> DataFrame:
    """``updated_at`` moved to ``as_of`` on rows that changed, unless it was set on purpose."""
    keep = explicit if explicit is not None else F.lit(False)
    return rows.withColumn("updated_at", F.when(changed & ~keep, as_of).otherwise(F.col("updated_at")))


def ensured(rows: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Rows with those of ``names`` added that are not there yet, each once."""
    fresh = names.dropDuplicates([key]).join(rows.select(key), key, "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


def renamed(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """A vault table after a scan: renamed files keep their row under the new path, updated ones get the new checksum, new ones come in."""
    moves = classified.where("status = 'renamed'").select(F.col("old_path").alias("path"), F.col("path").alias("new_path"))
    moves = moves.groupBy("path").agg(F.min("new_path").alias("new_path"))
    kept = rows.join(moves, "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
    fresh = classified.where("status <> 'unchanged'").select("path", "checksum")
    return merged(kept, fresh, ["path"], update={"checksum": "filled"})


def migrated(ledger: DataFrame, migrations: DataFrame) -> DataFrame:
    """Migrations still to run, in order, each once."""
    return migrations.join(ledger.select("version"), "version", "left_anti").orderBy("version")


def metrics(values: dict[str, DataFrame]) -> DataFrame:
    """Named one-value tables as one JSON object."""
    out = None
    for name, df in values.items():
        part = df.select(F.lit(name).alias("k"), F.col(df.columns[0]).cast("string").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("value"))
