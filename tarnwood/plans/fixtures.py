"""The driver's tables in the roles of the engine's entities, in Spark and, for the twins, in SQL.

What the tables lack (tiers, tags, times of access, missing vectors) is derived
from ids by fixed rules, the same on both sides.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem

AS_OF = "2024-02-01 00:00:00"


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints; a temporary one only on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='files-')).rstrip('/')}/tarnwood-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of sessions (their sources)."""
    d = F.col("doc_id")
    created = F.timestamp_add("DAY", (d % 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("text").alias("content"), F.col("source").alias("session_id"), "lang", created.alias("created_at"),
        F.when(d % 3 != 0, F.timestamp_add("HOUR", F.lit(12), created)).alias("last_accessed_at"), (d % 7).alias("access_count"),
        ((d % 10) / 10.0).alias("importance"), F.when(d % 5 == 0, F.array(F.lit("critical"), "lang")).otherwise(F.array("lang")).alias("tags"),
        F.when(d % 4 == 0, "archived").otherwise("active").alias("storage_tier"),
        F.concat(F.when(d % 3 == 0, "codex://").when(d % 3 == 1, "vault://").otherwise("notes/"), "source", F.lit("/"), d.cast("string"), F.lit(".md")).alias("path"),
    )


MEMORIES = """(SELECT doc_id AS id, text AS content, source AS session_id, lang,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INTEGER) AS created_at,
  CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INTEGER) + INTERVAL 12 HOUR END AS last_accessed_at,
  doc_id % 7 AS access_count, (doc_id % 10) / 10.0::DOUBLE AS importance,
  CASE WHEN doc_id % 5 = 0 THEN ['critical', lang] ELSE [lang] END AS tags,
  CASE WHEN doc_id % 4 = 0 THEN 'archived' ELSE 'active' END AS storage_tier,
  (CASE doc_id % 3 WHEN 0 THEN 'codex://' WHEN 1 THEN 'vault://' ELSE 'notes/' END) || source || '/' || doc_id || '.md' AS path
  FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stored vector 0, the fixed query of the examples: one row by a pushed-down filter."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


#: (id, score) of all vectors against vector 0.
SCORED = """(SELECT e.vec_id AS id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


#: The endings that words of the tables' invented prose take, for the forms that the twins list.
_ENDINGS = ("", "e", "s", "es", "ed", "ing", "ly", "edly", "ingly", "er", "ers", "eder")


def forms(word: str) -> list[str]:
    """The words that share the stem of ``word``, made of that stem and the endings above."""
    base = stem(word)
    return sorted({w for ending in _ENDINGS for w in (base + ending, base.removesuffix("e") + ending) if stem(w) == base} | {word})


def keyword_sql(query_words: list[str], source: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """(id, score) of the texts that hold a form of each of two or more words, by how close they stand, as a subquery."""
    n = len(query_words)
    listed = ["(" + ", ".join(f"'{f}'" for f in forms(w)) + ")" for w in query_words]
    places = ", ".join(f"list_sort(list_distinct(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] IN {f}), lambda i: least(i, 16383))))[:255] AS p{k}" for k, f in enumerate(listed))
    held = " AND ".join(f"len(p{k}) > 0" for k in range(n))
    close = "CASE WHEN d > 100 THEN 0.1 * sqrt(1e-30) ELSE 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))) END"
    pair = "coalesce(list_sum(flatten(list_transform(p{}, lambda a: list_transform(list_filter(list_transform(p{}, lambda b: abs(a - b)), lambda d: d > 0), lambda d: ln(1 - " + close + "))))), 0)"
    rest = " + ".join(pair.format(i, j) for i in range(n) for j in range(i + 1, n))
    return f"""(WITH tok AS (SELECT {id_col} AS id, list_filter(string_split_regex(lower(coalesce({text_col}, '')), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM {source}),
  c AS (SELECT id, {places} FROM tok), r AS (SELECT id, 1 - exp({rest}) AS raw FROM c WHERE {held})
  SELECT id, floor(raw / (raw + 1) * 1e9 + 0.5) / 1e9 AS score FROM r)"""
