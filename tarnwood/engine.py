"""The engine's calls over a store: search, context, sessions, memories, lists and status.

Each call is a plan over the stored tables; writes make a new version of a table.
Times come from the caller (``now``), and vectors from an embedder given at the
start; without one every search is by keyword.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores, texts
from .operators import catalog, mining, retrieval, textindex, upkeep
from .plans import store as tables
from .schemas import TABLES

_ORDER = {"agents": "last_seen_at", "sessions": "started_at", "procedures": "times_used"}


class Engine:
    """Calls by name, as agents make them."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.store, self.embed = spark, tables.Store(spark, root), embed
        self.paused = False
        self.indexes: dict[str, tuple[int | None, textindex.TextIndex]] = {}

    def table(self, name: str) -> DataFrame:
        """A stored table; an empty one of its schema before the first write."""
        return self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], TABLES[name])

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A stored table as ``change`` makes it; another writer's rows that come meanwhile are changed too."""
        none = self.spark.createDataFrame([], TABLES[name])
        self.store.replace(name, lambda rows: change(none if rows is None else rows))

    def _insert(self, name: str, row: dict) -> str:
        row = {"id": uuid.uuid4().hex, **row}
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        self.store.append(name, self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema))
        return row["id"]

    # Searching

    def index_texts(self, name: str) -> None:
        """Index a stored table's texts; searches use it as long as the table's version is that which was indexed."""
        version, text = self.store.version(name), retrieval.search_columns(name)[0]
        found = textindex.TextIndex(self.spark, f"{self.store.root}/_indexes/{name}-{uuid.uuid4().hex}")
        self.indexes[name] = version, found.build(self.table(name), text_col=text)

    def _index(self, name: str) -> textindex.TextIndex | None:
        version, index = self.indexes.get(name, (None, None))
        return index if index is not None and version == self.store.version(name) else None

    def memory_search(self, query: str, limit: int = 10, mode: str = "hybrid", *, session_id: str | None = None, now: datetime.datetime | None = None) -> DataFrame:
        """The best rows of four tables, best first; what a session sees is logged."""
        vector = self.embed(query) if self.embed else None
        found = {}
        for name in ("memories", "documents", "experiences", "trading_results"):
            rows, (text, _) = self.table(name), retrieval.search_columns(name)
            aged = F.lit(now) if now is not None and name == "memories" and mode not in ("vector", "keyword") else None
            found[name] = retrieval.hybrid_search(
                rows, rows.where("embedding is not null"), query, vector, mode if vector else "keyword", limit,
                text_col=text, full_text=name != "trading_results", decay_as_of=aged, index=self._index(name) if name != "trading_results" else None,
            ).select("id", "score")
        best = retrieval.federated(found, limit)
        if session_id is not None:
            best = self.spark.createDataFrame(best.collect(), best.schema)  # at most ``limit`` rows, searched for once
            log = best.select(
                F.lit(session_id).alias("session_id"), "source_table", F.col("id").alias("source_id"), F.lit("search").alias("interaction_type"),
                F.col("score").alias("relevance_score"), F.lit(now).cast("timestamp").alias("accessed_at"),
            )
            self.store.append("access_log", log)
        return best

    def memory_context(self, query: str, limit: int = 5) -> DataFrame:
        """A package of sections: similar and matching memories, recent sessions, used procedures, trading results."""
        m = self.table("memories")
        sections = {"keyword": textindex.keyword_topk(m, query, limit)}
        if self.embed:
            sections["similar"] = retrieval.vector_topk(m.where("embedding is not null"), self.embed(query), limit, 0.5)
        by = lambda name, ts: self.table(name).select("id", F.coalesce(F.unix_seconds(ts).cast("double"), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(3)
        sections["sessions"] = by("sessions", "started_at")
        sections["trading_results"] = by("trading_results", "created_at")
        used = self.table("procedures").select("id", F.col("times_used").cast("double").alias("score"))
        sections["procedures"] = used.orderBy(F.desc("score"), "id").limit(3)
        return retrieval.context_package(sections)

    def experience_find(self, query: str, limit: int = 3) -> DataFrame:
        """Whole experiences in the order of their keyword rank."""
        found = retrieval.ranked(textindex.keyword_topk(self.table("experiences"), query, limit, text_col="goal"))
        return self.table("experiences").join(F.broadcast(found.select("id", "rank", "score")), "id").orderBy("rank")  # at most ``limit`` rows

    def procedure_run(self, name: str) -> DataFrame:
        """The procedure of a name, in any case; its use is counted by ``procedure_ran``."""
        return self.table("procedures").where(F.lower("name") == name.lower())

    def procedure_search(self, text: str, limit: int = 5) -> DataFrame:
        like = F.col("name").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%")
        return self.table("procedures").where(like).orderBy(F.desc("times_used"), "id").limit(limit)

    def procedure_ran(self, key: str, success: bool) -> None:
        n = F.col("times_used")
        rate = (F.coalesce("success_rate", F.lit(0.0)) * n + F.lit(float(success))) / (n + 1)
        self._change("procedures", lambda rows: tables.updated(rows, F.col("id") == key, {"success_rate": rate, "times_used": n + 1}))

    def recall(self, key: str) -> DataFrame:
        """The table and row of an id, looked for in a fixed order, documents by path last."""
        docs = self.table("documents").select(F.col("path").alias("id"))
        ordered = [(n, self.table(n)) for n in ("memories", "sessions", "experiences", "procedures")]
        return retrieval.recall([*ordered, ("documents", docs)], key)

    # Writing

    def memory_store(self, content: str, now: datetime.datetime, *, importance: float = 0.5, tags: list[str] | None = None, session_id: str | None = None, critical: bool = False) -> str:
        """A new memory, with its vector where there is an embedder."""
        tags = list(tags or [])
        if critical:
            importance, tags = max(importance, 0.9), tags + ["critical"] * ("critical" not in tags)
        vector = [float(x) for x in self.embed(content)] if self.embed else None
        key = self._insert("memories", {
            "content": content, "content_type": "text", "embedding": vector, "importance": importance, "tags": tags, "session_id": session_id,
            "access_count": 0, "storage_tier": "active", "created_at": now, "updated_at": now,
        })
        if vector:
            row = self.spark.createDataFrame([("memories", key, vector, now)], TABLES["embeddings"])
            self.store.append("embeddings", row)
        return key

    def memory_initialize(self, memories: list[str], now: datetime.datetime) -> list[str]:
        """Several memories, those there already left out."""
        known = {r.content for r in self.table("memories").where(F.col("content").isin(memories)).select("content").collect()} if memories else set()
        return [self.memory_store(m, now) for m in dict.fromkeys(memories) if m not in known]

    def experience_store(self, goal: str, result: str, now: datetime.datetime, *, lessons: str | None = None, confidence: float | None = None) -> str:
        return self._insert("experiences", {"goal": goal, "result": result, "lessons_learned": lessons, "confidence": confidence, "is_procedurized": False, "created_at": now})

    def experience_outcome(self, key: str, success: bool) -> None:
        after = scores.confidence_after(F.col("confidence"), F.lit(success))
        self._change("experiences", lambda rows: tables.updated(rows, F.col("id") == key, {"confidence": after}))

    def procedure_create(self, name: str, description: str, steps: str, now: datetime.datetime) -> str:
        """A procedure of a new name; a name that is taken is an error."""
        if not self.table("procedures").where(F.col("name") == name).isEmpty():
            raise ValueError(f"procedure {name!r} is there already")
        return self._insert("procedures", {"name": name, "description": description, "steps": steps, "times_used": 0, "created_at": now})

    def forget(self, key: str) -> None:
        self._change("memories", lambda rows: tables.forgotten(rows, F.col("id") == key))

    def session_start(self, goal: str, now: datetime.datetime, *, agent_id: str | None = None, parent: str | None = None) -> str:
        return self._insert("sessions", {"goal": goal, "agent_id": agent_id, "parent_session_id": parent, "status": "active", "started_at": now})

    def session_end(self, key: str, summary: str, now: datetime.datetime) -> None:
        done = {"status": F.lit("completed"), "summary": F.lit(summary), "ended_at": F.lit(now)}
        self._change("sessions", lambda rows: tables.updated(rows, F.col("id") == key, done))

    def session_embedding(self, key: str, vector: list[float]) -> None:
        value = F.array(*map(F.lit, vector)).cast("array<float>")
        self._change("sessions", lambda rows: tables.updated(rows, F.col("id") == key, {"embedding": value}))

    def trading_result_store(self, strategy: str, now: datetime.datetime, *, symbol: str | None = None, notes: str | None = None, pnl: float | None = None) -> str:
        return self._insert("trading_results", {"strategy": strategy, "symbol": symbol, "notes": notes, "pnl": pnl, "created_at": now})

    def session_context(self, key: str, limit: int = 50) -> DataFrame:
        """What a session looked at, newest first."""
        return self.table("access_log").where(F.col("session_id") == key).orderBy(F.desc("accessed_at"), "source_table", "source_id").limit(limit)

    def session_compact(self, key: str) -> None:
        """Put the older one of each two nearly equal memories of a session aside."""
        self._change("memories", lambda rows: mining.compacted(rows, mining.superseded(rows.where(F.col("session_id") == key))))

    # Looking on

    def list(self, name: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return upkeep.offset_page(self.table(name), [F.desc(_ORDER.get(name, "created_at")), "id"], limit, offset)

    def status(self) -> DataFrame:
        return catalog.table_counts({n: self.table(n) for n in TABLES})

    def storage_catalog(self) -> DataFrame:
        sized = {n: (self.table(n), F.octet_length("content")) for n in ("memories", "documents")}
        return catalog.storage_catalog(sized)

    def archive_status(self) -> DataFrame:
        return self.table("memories").groupBy("storage_tier").agg(F.count("*").alias("n"))

    def memory_health(self, dimension: int) -> DataFrame:
        return catalog.embedding_coverage({n: self.table(n) for n in ("memories", "documents", "experiences")}, dimension)

    def dashboard_status(self, pending: int, failed: int, reachable: bool = True) -> DataFrame:
        action = texts.next_action(F.lit(self.paused), F.lit(reachable), F.lit(pending), F.lit(failed))
        return self.spark.range(1).select(action.alias("next_action"), F.lit(pending).alias("pending"), F.lit(failed).alias("failed"))

    def dashboard_control(self, action: str) -> None:
        """``pause`` or ``resume``."""
        self.paused = {"pause": True, "resume": False}[action]
