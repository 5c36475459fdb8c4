"""The corpus pipeline: raw documents to packed training sequences.

Quality and toxicity, near-duplicates, benchmark passages, secrets, packing. Each
stage works on all rows that the stage before it kept, written as Parquet and
read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.llm.common import shared_folder, table
from tarnwood.llm.cotrain import score_quality
from tarnwood.llm.decontaminate import find_overlaps
from tarnwood.llm.near_dup import near_duplicates
from tarnwood.llm.packing import pack_documents
from tarnwood.llm.secrets_scan import find_secrets, redact

#: SQL cannot express the trained first stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; narrow."""
    return score_quality(docs, table(spark, sf_dir, "labels"), carry="document").where("kept").select("document.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies over five-word shingles.

    Of rows that repeat an id and its text, one stays.
    """
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; narrow."""
    return find_overlaps(docs, table(spark, sf_dir, "benchmark"), carry="document").where("not contaminated").select("document.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts and their lengths set anew; narrow and free of Python."""
    clean = redact(find_secrets(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences, a row per piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
