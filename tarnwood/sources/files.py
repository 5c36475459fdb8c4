"""Whole-file scans and what is derived from a file's place and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.texts import uri, vault_section, vault_section_or_null


def scan(spark: SparkSession, root: str, glob: str = "*", *, content: bool = True, max_files: int | None = None) -> DataFrame:
    """Files below ``root``: relative ``path``, ``modified_at``, ``size``, and with ``content`` their text and SHA-256.

    Newest first where ``max_files`` is given, ties by path. Bytes that are not
    UTF-8 become replacement characters. Names that begin with a dot or an
    underscore are hidden to Spark's readers. Without ``content`` no file is opened.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    full = F.regexp_replace("path", "^file:/*", "/")
    path = F.when(full.startswith(base), F.substring(full, F.length(base) + 2, F.length(full))).otherwise(full)
    columns = [path.alias("path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size")]
    if content:
        columns += [F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("checksum")]
    rows = read.select(*columns)
    return rows if max_files is None else rows.orderBy(F.desc("modified_at"), "path").limit(max_files)


def vault(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Markdown files but those under dotted names, with title, section, frontmatter, body and token estimate."""
    rows = scan(spark, root, "*.md").where(~F.col("path").rlike(r"(^|/)\."))
    if max_files is not None:
        rows = rows.orderBy(F.desc("modified_at"), "path").limit(max_files)
    rows = rows.withColumn("parsed", markup.frontmatter("text"))
    rows = rows.select("*", F.col("parsed.frontmatter").alias("frontmatter"), F.col("parsed.body").alias("body")).drop("parsed")
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    return rows.select(
        uri("vault", F.col("path")).alias("uri"), "path", vault_section(F.col("path")).alias("section"),
        markup.title(F.col("body"), F.col("path")).alias("title"), "frontmatter", "body", "checksum", "size", "modified_at",
        F.round(words / 0.75).cast("long").alias("token_count"),
    )


def new_notes(spark: SparkSession, root: str, known: DataFrame, limit: int | None = None) -> DataFrame:
    """The scripts' variant: blank files and known paths are left out, files at the root have no section."""
    rows = scan(spark, root, "*.md").where(F.col("text").rlike(r"\S")).join(known.select("path"), "path", "left_anti")
    rows = rows.select("path", vault_section_or_null(F.col("path")).alias("section"), markup.title(F.col("text"), F.col("path")).alias("title"), "text", "checksum")
    return rows if limit is None else rows.orderBy("path").limit(limit)


def vault_chunks(notes: DataFrame) -> DataFrame:
    """A row for each header chunk: ``path``, ``place`` from 0, ``heading``, ``text``."""
    spread = notes.select("path", F.posexplode(markup.markdown_chunks("body")).alias("place", "chunk"))
    return spread.select("path", "place", "chunk.heading", "chunk.text")


def settled(files: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """One row: whether the newest file is at least ``seconds`` old; true without files."""
    newest = files.agg(F.max("modified_at").alias("newest"))
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds("newest")
    return newest.select("newest", F.coalesce(age >= seconds, F.lit(True)).alias("settled"))


def retention_violations(folders: DataFrame, cutoff: Column) -> DataFrame:
    """Folders named by a date before ``cutoff``; other names do not count."""
    day = F.try_to_timestamp("name", F.lit("yyyyMMdd")).cast("date")
    return folders.withColumn("day", F.when(F.col("name").rlike(r"^\d{8}$"), day)).where(F.col("day") < cutoff)


def backup_coverage(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Each target with its files and whether there are any."""
    counted = files.groupBy("label").agg(F.count("*").alias("files"))
    both = targets.join(counted, "label", "left").select("label", F.coalesce("files", F.lit(0)).alias("files"))
    return both.withColumn("covered", F.col("files") > 0)
