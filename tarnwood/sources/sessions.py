"""Session archives: JSON lines a file, tagged JSON lines, conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import agent_name, model_name, preview
from ..operators.scans import last_before

#: What a session's head line may name.
_META = ("session_id", "timestamp", "cwd", "originator", "source", "thread_source", "model_provider", "cli_version")
_MESSAGE = "array<struct<type:string,text:string>>"


def archive_lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """(``file``, ``line_no``, ``line``) of every archive below ``root``.

    Lines are numbered by their place in the file: a file is one row until it is
    split, so the order is the file's own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r?\n$", "")
    split = F.when(F.length(F.decode("content", "UTF-8")) > 0, F.split(text, "\r?\n"))
    return files.select(F.col("path").alias("file"), F.posexplode(split).alias("line_no", "line"))


def summaries(lines: DataFrame) -> DataFrame:
    """One row a file: lines, messages, tool calls, first words of either side, and the last ``session_meta``.

    Lines that do not parse count as lines only. Tool calls are messages too.
    """
    kind = F.get_json_object("line", "$.type")
    payload = lambda p: F.get_json_object("line", f"$.payload.{p}")
    is_item, is_meta = kind == "response_item", kind == "session_meta"
    parts = F.from_json(F.when(is_item & (payload("type") == "message"), payload("content")), _MESSAGE)
    text = lambda t: F.get(F.filter(parts, lambda c: (c["type"] == t) & c["text"].isNotNull()), 0)["text"]
    rows = lines.select(
        "file", "line_no", kind.alias("kind"), payload("type").alias("item"), text("input_text").alias("said"), text("output_text").alias("answered"),
        F.when(is_meta, F.struct(*[payload(m).alias(m) for m in _META])).alias("meta"),
    )
    first = lambda c: preview(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line_no"))), 240)
    out = rows.groupBy("file").agg(
        F.count("*").alias("line_count"), F.count_if(F.col("kind") == "response_item").alias("message_count"),
        F.count_if((F.col("kind") == "response_item") & (F.col("item") == "function_call")).alias("tool_call_count"),
        first("said").alias("user_excerpt"), first("answered").alias("assistant_excerpt"),
        F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col("line_no"))).alias("meta"),
    )
    return out.select(*[c for c in out.columns if c != "meta"], *[F.col(f"meta.{m}").alias(m) for m in _META])


def tagged_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of kinds ``session``, ``part``, ``todo`` and ``metadata`` from JSON lines, by an explicit schema."""
    return spark.read.schema(schema).json(path)


def session_parts(records: DataFrame) -> DataFrame:
    """Parts (``role``, ``text``) with the ``session_id`` and ``title`` of the last session record before them in their file.

    Records carry ``file`` and ``line_no``; what ids a part itself names does not
    count, and parts before a file's first session are left out.
    """
    head = F.when(F.col("kind") == "session", F.struct("session_id", "title"))
    placed = last_before(records, ["file"], "line_no", head, "head")
    return placed.where("kind = 'part' and head is not null").select("head.session_id", "role", "text", "head.title")


def rollup(parts: DataFrame, *, least: int = 50, in_bytes: bool = True) -> DataFrame:
    """Per session: parts, long user messages, and seconds from first to last, never under 0."""
    size = F.octet_length("text") if in_bytes else F.length("text")
    return parts.groupBy("session_id").agg(
        F.count("*").alias("parts"), F.count_if((F.col("role") == "user") & (size > least)).alias("long_prompts"),
        F.greatest(F.lit(0), F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at"))).alias("seconds"),
    )


def normalised(sessions: DataFrame) -> DataFrame:
    """Sessions with agent, model and title made plain; the title falls back to the slug, then the id."""
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return sessions.select(
        "session_id", agent_name(F.col("agent")).alias("agent"), model_name(F.col("model")).alias("model"),
        F.coalesce(given("title"), given("slug"), F.col("session_id")).alias("title"),
    )


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and checksum are not known yet."""
    return files.join(known.select("path", "checksum"), ["path", "checksum"], "left_anti")


def fan_out(sessions: DataFrame, parts: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """What an import writes for sessions that are not there yet: session, experience, summary and long-message rows."""
    new = sessions.join(known.select("session_id"), "session_id", "left_anti")
    own = parts.join(new.select("session_id"), "session_id", "left_semi")
    summary = F.concat_ws("\n", F.concat(F.lit("goal: "), "title"), F.concat(F.lit("summary: "), F.nullif(F.trim("summary"), F.lit(""))))
    return {
        "sessions": new.select("session_id", "title", "summary"),
        "experiences": new.select("session_id", F.col("title").alias("goal"), F.lit("success").alias("result")),
        "summaries": new.select("session_id", summary.alias("content"), F.lit("summary").alias("content_type")),
        "messages": own.where((F.col("role") == "user") & (F.octet_length("text") > 50)).select("session_id", F.col("text").alias("content"), F.lit("message").alias("content_type")),
    }


def duration_seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_seconds(end) - F.unix_seconds(start))
