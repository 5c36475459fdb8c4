"""Configuration, rule and skill files, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import uri
from .files import scan


def config_rollup(files: DataFrame) -> DataFrame:
    """Sizes of the ``agent``, ``command`` and ``mcp`` objects and of ``instructions``; 0 where a file is not strict JSON."""
    keys = lambda k: F.coalesce(F.size(F.json_object_keys(F.get_json_object("text", f"$.{k}"))), F.lit(0))
    listed = F.coalesce(F.json_array_length(F.get_json_object("text", "$.instructions")), F.lit(0))
    valid = F.get_json_object("text", "$").isNotNull()
    counts = {"agents": keys("agent"), "commands": keys("command"), "servers": keys("mcp"), "instructions": listed}
    return files.select("path", *[F.when(valid, v).otherwise(F.lit(0)).alias(k) for k, v in counts.items()])


def configs(spark: SparkSession, root: str, *, nested_rules: bool = False) -> DataFrame:
    """Configuration documents of a folder: ``uri``, ``kind``, ``category``, ``text``, ``checksum``.

    Rules are those directly under ``rules``, their category the folder's name;
    with ``nested_rules`` also those below, their category the first folder.
    """
    files = scan(spark, root, "*")
    parts = F.split("path", "/")
    is_config = F.col("path").rlike(r"^[^/]+\.jsonc?$")
    is_rule = F.col("path").rlike(r"^rules/.+\.md$") if nested_rules else F.col("path").rlike(r"^rules/[^/]+\.md$")
    is_skill = F.col("path").rlike(r"^skills/.+\.md$")
    kind = F.when(is_config, "config").when(is_rule, "rules").when(is_skill, "skill")
    nested = F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise(F.lit("rules"))
    category = F.when(is_rule, nested if nested_rules else F.lit("rules")).when(is_skill, F.get(parts, 1))
    rows = files.select("path", "text", "checksum", kind.alias("kind"), category.alias("category")).where("kind is not null")
    address = F.when(F.col("kind") == "config", uri("config", F.col("path"))).when(F.col("kind") == "rules", uri("rules", F.regexp_replace("path", "^rules/", "")))
    return rows.select(address.otherwise(uri("skill", F.regexp_replace("path", "^skills/", ""))).alias("uri"), "kind", "category", "text", "checksum")


def log_rollup(lines: DataFrame, *, every_match: bool = False) -> DataFrame:
    """One row: lines, distinct sessions, models and agents, and errors of a log (``line``).

    With ``every_match`` all matches of a line count, and errors are substrings;
    else the first match, and errors are lines with the whole word.
    """
    def found(pattern: str):
        if every_match:
            return F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        first = F.regexp_extract("line", pattern, 1)
        return F.filter(F.array(first), lambda x: x != "")

    patterns = {"sessions": r"session\.id=(ses_\w+)", "models": r"modelID=([\w.-]+)", "agents": r'agent="([^"]+)"'}
    rows = lines.select("line", *[found(p).alias(n) for n, p in patterns.items()])
    errors = F.sum((F.length("line") - F.length(F.replace("line", F.lit("level=ERROR"), F.lit("")))) / 11).cast("long") if every_match else F.count_if(F.col("line").rlike(r"\blevel=ERROR\b"))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long").alias(c)
    return rows.agg(F.count("*").alias("lines"), *map(distinct, patterns), F.coalesce(errors, F.lit(0)).alias("errors"))


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row: the value of a key, or the default."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))
