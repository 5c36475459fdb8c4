"""Fusion, mining, upkeep, sources, store and change capture on small rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tarnwood.operators import blocks, catalog, mining, retrieval, textindex, upkeep
from tarnwood.plans import cdc, store
from tarnwood.sources import configs, files, sessions
from tarnwood.streaming import intake, outbox


def listed(spark, scores):
    return spark.createDataFrame(list(scores.items()), "id string, score double")


def test_rrf(spark):
    got = {r.id: r for r in retrieval.rrf(listed(spark, {"A": 0.9, "B": 0.8}), listed(spark, {"C": 0.9, "B": 0.8})).collect()}
    best = max(got.values(), key=lambda r: r.score)
    assert (best.id, best.vec_rank, best.kw_rank) == ("B", 2, 2) and len(got) == 3
    none = spark.createDataFrame([], "id string, score double")
    only = retrieval.rrf(listed(spark, {"x": 1.0}), none).collect()
    assert [(r.score, r.vec_rank, r.kw_rank) for r in only] == [(0.0286, 1, None)]
    assert retrieval.rrf(none, none).collect() == []
    a, b = listed(spark, {"A": 1.0}), listed(spark, {"B": 1.0})
    first = lambda v, k: retrieval.top(retrieval.rrf(a, b, vector_weight=v, keyword_weight=k), 1).first().id
    assert (first(0.9, 0.1), first(0.1, 0.9)) == ("A", "B")


@pytest.mark.parametrize(
    "vec, kw, want",
    [
        ({"A": 0.95, "B": 0.50}, {"B": 0.80, "A": 0.60}, {"A": 0.9, "B": 0.7158}), ({"A": 0.90}, {"B": 0.85}, {"A": 0.64, "B": 0.46}),
        ({"A": 0.90, "B": 0.60, "C": 0.30}, {"C": 0.95, "B": 0.50, "A": 0.20}, {"A": 0.6842, "B": 0.6105, "C": 0.6}), ({"x": 0.95}, {}, {"x": 0.64}),
    ],
)
def test_rsf(spark, vec, kw, want):
    side = lambda s: spark.createDataFrame(list(s.items()), "id string, score double")
    assert {r.id: r.score for r in retrieval.rsf(side(vec), side(kw)).collect()} == pytest.approx(want, abs=1e-9)


def test_rrf_does_not_depend_on_partitions(spark):
    v, k = listed(spark, {f"v{i}": 1 - i / 100 for i in range(40)}), listed(spark, {f"v{i}": i / 100 for i in range(20, 60)})
    assert {tuple(r) for r in retrieval.rrf(v, k).collect()} == {tuple(r) for r in retrieval.rrf(v.repartition(7), k.repartition(3)).collect()}


def test_modes(spark):
    rows = spark.createDataFrame([(i, t, datetime.datetime(2024, 1, 1), None) for i, t in enumerate(["red fox", "blue fox", "green hen"])], "id long, content string, created_at timestamp, last_accessed_at timestamp")
    vec = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 1.0]) for i in range(3)], "id long, embedding array<float>")
    search = lambda mode, **k: retrieval.hybrid_search(rows, vec, "fox", [1.0, 0.0, 0.0], mode, 10, **k)
    assert [r.id for r in search("vector").collect()] == [0]
    assert sorted(r.id for r in search("keyword").collect()) == [0, 1]
    assert [r.id for r in search("no such mode").collect()] == [r.id for r in search("hybrid").collect()]
    fresh, old = search("hybrid"), search("hybrid", decay_as_of=F.lit(datetime.datetime(2024, 3, 31)))
    assert old.first().score == pytest.approx(fresh.first().score / 2)
    assert [r.id for r in retrieval.hybrid_search(rows, vec, "greeen hen", None, "hybrid").collect()] == [2]
    assert retrieval.search_columns("trading_results") == ("notes", "strategy") and retrieval.search_columns("?") == ("content", "tags")


def test_top_k_plan_and_pushdown(spark, small):
    docs = spark.read.parquet(f"{small}/orders.parquet")
    plan = docs.where("o_orderkey = 7").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    vec = spark.read.parquet(f"{small}/embeddings.parquet")
    found = retrieval.vector_topk(vec, [1.0] * 64, 5, id_col="vec_id")
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()


def test_index_matches_ranking(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat cat dog"), (3, None)], "id long, content string")
    got = {(r.term, r.id): (r.tf, r.length) for r in textindex.postings(docs).collect()}
    assert got == {("cat", 1): (1, 2), ("sat", 1): (1, 2), ("cat", 2): (2, 3), ("dog", 2): (1, 3)}
    assert [r.id for r in textindex.fts_topk(docs, "The Cat!", 5).collect()] == [2, 1]
    assert textindex.fts_topk(docs, "the", 5).collect() == []


def test_block_pairs_and_neighbours(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(60, 5))
    m[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, embedding array<double>")
    u = m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), np.inf)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.6}
    assert {(r.a, r.b) for r in blocks.similar_pairs(rows, 0.6, size=13).collect()} == want
    near = mining.nearest(rows, 3, 0.1).groupBy("a").count().collect()
    assert max(r["count"] for r in near) <= 3


def test_contradictions(spark):
    memories = spark.createDataFrame([(1, "always buy"), (2, "never sell"), (3, "always buy")], "id long, content string")
    vec = spark.createDataFrame([(i, [1.0, i / 100]) for i in (1, 2, 3)], "id long, embedding array<double>")
    got = sorted((r.a, r.b, r.signals) for r in mining.contradictions(memories, vec).collect())
    assert got == [(1, 2, 2), (2, 3, 2)]


def test_compaction(spark):
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(40), rng.randint(0, 4)):
            w[at] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w), f"s{i % 2}"))
    rows += [(100, "", "s0"), (101, " ", "s0"), (102, None, "s1")]
    sets = {i: (set((t or "").split()), s) for i, t, s in rows}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(i, j) for i in sets for j in sets if i < j and sets[i][1] == sets[j][1] and alike(sets[i][0], sets[j][0]) > 0.9}
    memories = spark.createDataFrame(rows, "id long, content string, session_id string").withColumns({"importance": F.lit(0.5), "tags": F.array(F.lit("t"))})
    pairs = mining.compaction_pairs(memories)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 10
    twice = mining.compacted(mining.compacted(memories, pairs), pairs).collect()
    assert {r.id for r in twice if r.importance == 0} == {a for a, _ in want}
    assert all(r.tags.count("compacted") == (r.importance == 0) for r in twice)


def test_batches(spark):
    rows = spark.createDataFrame([(i, 10, "t") for i in range(26)] + [(100, 3 << 20, "u"), (101, 5, "u")], "id long, b long, t string")
    got = {r.id: (r.t, r.batch) for r in upkeep.pack_batches(rows, "id", "b", "t").collect()}
    assert len({v for v in got.values() if v[0] == "t"}) == 2 and got[24] == ("t", 0) and got[25] == ("t", 1)
    assert got[100] != got[101]


def test_pages_meet(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(20)], "ts int, id int")
    seen, after = [], None
    while page := upkeep.keyset_page(rows, "ts", "id", after, 6).collect():
        seen += [r.id for r in page]
        after = (page[-1].ts, page[-1].id)
    assert seen == list(range(20))


def test_vault(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "notes" / "a.md").write_text("---\ntitle: x\n---\n# Alpha\n## One\ntext one\n")
    (tmp_path / "root.md").write_text("plain words here")
    (tmp_path / ".trash" / "gone.md").write_text("no")
    (tmp_path / "blank.md").write_text(" ")
    notes = files.vault(spark, str(tmp_path))
    got = {r.path: r for r in notes.collect()}
    assert set(got) == {"notes/a.md", "root.md", "blank.md"}
    assert (got["notes/a.md"].title, got["notes/a.md"].section, got["notes/a.md"].uri) == ("Alpha", "notes", "vault://notes/a.md")
    assert (got["root.md"].title, got["root.md"].token_count) == ("root", 4)
    assert sorted((r.heading, r.text) for r in files.vault_chunks(notes).where("path = 'notes/a.md'").collect()) == [("One", "text one"), ("Untitled", "Alpha")]
    known = spark.createDataFrame([("root.md",)], "path string")
    assert {(r.path, r.section) for r in files.new_notes(spark, str(tmp_path), known).collect()} == {("notes/a.md", "notes")}
    moved = notes.select(F.when(F.col("path") == "root.md", "moved.md").otherwise(F.col("path")).alias("path"), "checksum")
    status = {r.path: (r.status, r.old_path) for r in upkeep.classify_files(moved, notes.select("path", "checksum")).collect()}
    assert status["moved.md"] == ("renamed", "root.md") and status["notes/a.md"] == ("unchanged", None)
    assert files.settled(files.scan(spark, str(tmp_path), "*.md", content=False), F.lit(datetime.datetime(2100, 1, 1))).first().settled


def test_session_archives(spark, tmp_path):
    lines = [
        '{"type":"session_meta","payload":{"session_id":"s1","timestamp":"2024-01-01T00:00:00Z","cwd":"/w","model_provider":"p"}}',
        '{"type":"response_item","payload":{"type":"message","content":[{"type":"input_text","text":"hello"}]}}',
        '{"type":"response_item","payload":{"type":"message","content":[{"type":"output_text","text":"' + "y" * 300 + '"}]}}',
        '{"type":"response_item","payload":{"type":"function_call"}}', "not json", '{"type":"event_msg","payload":{"type":"token_count"}}',
        '{"type":"session_meta","payload":{"session_id":"s2"}}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    got = sessions.summaries(sessions.archive_lines(spark, str(tmp_path))).first()
    assert (got.line_count, got.message_count, got.tool_call_count) == (7, 3, 1)
    assert got.user_excerpt == "hello" and got.assistant_excerpt == "y" * 240 + "..."
    assert (got.session_id, got.cwd) == ("s2", None)


def test_imports(spark):
    s = spark.createDataFrame([("a", "Goal", "sum"), ("b", "Old", None)], "session_id string, title string, summary string")
    parts = spark.createDataFrame([("a", "user", "x" * 60), ("a", "user", "short"), ("b", "user", "y" * 60)], "session_id string, role string, text string")
    out = sessions.fan_out(s, parts, s.where("session_id = 'b'"))
    assert [r.session_id for r in out["sessions"].collect()] == ["a"] and out["messages"].count() == 1
    assert out["summaries"].first().content == "goal: Goal\nsummary: sum"
    plain = sessions.normalised(spark.createDataFrame([("i", '{"name":"z"}', "m", " ", "slug")], "session_id string, agent string, model string, title string, slug string")).first()
    assert (plain.agent, plain.model, plain.title) == ("z", "m", "slug")


def test_configs_and_logs(spark, tmp_path):
    (tmp_path / "rules" / "deep").mkdir(parents=True)
    (tmp_path / "skills" / "cat").mkdir(parents=True)
    (tmp_path / "main.json").write_text('{"agent":{"a":{},"b":{}},"mcp":{"x":1},"instructions":["i","j"]}')
    (tmp_path / "odd.jsonc").write_text("// no\n{}")
    (tmp_path / "rules" / "r.md").write_text("r")
    (tmp_path / "rules" / "deep" / "d.md").write_text("d")
    (tmp_path / "skills" / "cat" / "s.md").write_text("s")
    flat, nested = configs.configs(spark, str(tmp_path)), configs.configs(spark, str(tmp_path), nested_rules=True)
    assert {(r.kind, r.category) for r in flat.collect()} == {("config", None), ("rules", "rules"), ("skill", "cat")}
    assert ("rules", "deep") in {(r.kind, r.category) for r in nested.collect()}
    sizes = {r.path: (r.agents, r.commands, r.servers, r.instructions) for r in configs.config_rollup(files.scan(spark, str(tmp_path), "*.json*")).collect()}
    assert sizes["main.json"] == (2, 0, 1, 2) and sizes["odd.jsonc"] == (0, 0, 0, 0)
    log = spark.createDataFrame([('session.id=ses_1 modelID=m.1 session.id=ses_2 agent="x" level=ERROR level=ERROR',), ("plain",)], "line string")
    assert tuple(configs.log_rollup(log).first()) == (2, 1, 1, 1, 1) and tuple(configs.log_rollup(log, every_match=True).first()) == (2, 2, 1, 1, 2)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    s.write("t", old)
    before = s.read("t")
    s.upsert("t", spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id long, name string, n int"), ["id"], update={"name": "filled"})
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert before.count() == 2
    s.append("t", spark.createDataFrame([(4, "d", 4)], "id long, name string, n int"))
    assert s.read("t").count() == 4 and not s.exists("other")
    untouched = set(s._folders("t", 1))
    assert len(s._folders("t", 2)) == 2 and untouched < set(s._folders("t", 2))
    s._fs.create(s._at(f"{tmp_path}/t/_versions/{3:012d}"), False).close()  # a writer that failed
    s._commit("t", lambda last: s._folders("t", last), patience=0.2)
    assert s._versions("t") == [0, 1, 2, 4] and s.read("t").count() == 4
    s.vacuum("t", keep=1)
    assert s._versions("t") == [4] and s.read("t").count() == 4
    tight = store.Store(spark, f"{tmp_path}/tight", most_parts=2)
    for k in range(4):
        tight.append("t", old.withColumn("n", F.lit(k)))
    assert tight.read("t").count() == 8 and len(tight._folders("t", tight._versions("t")[-1])) <= 2
    lines, manifest = store.bundle(s.read("t"), "id")
    assert lines.count() == manifest.first().records == 4 and len(manifest.first().sha256) == 64
    assert store.bundle(s.read("t").repartition(3), "id")[1].first() == manifest.first()
    assert store.bundle(s.read("t").withColumn("n", F.lit(5)), "id")[1].first().sha256 != manifest.first().sha256
    kept, gone = store.archived(old, old.where("id = 1"), ["id"])
    assert (kept.count(), gone.count()) == (1, 1)


def test_change_capture(spark):
    old = spark.createDataFrame([(1, "a", "active", 1), (2, "b", "active", 1), (3, "c", "active", 1), (4, "d", "active", 1)], "id long, content string, storage_tier string, updated_at long")
    new = spark.createDataFrame([(1, "a", "active", 2), (2, "B", "active", 2), (3, "c", "archived", 2), (5, "e", "active", 1)], old.schema)
    got = {r.record_key: (r.operation, r.payload) for r in cdc.changes(old, new, "id").collect()}
    assert {k: v[0] for k, v in got.items()} == {"2": "upsert", "3": "archive", "4": "delete", "5": "upsert"}
    assert "content" in got["2"][1] and "content" not in got["3"][1] and got["4"][1] is None
    queue = spark.createDataFrame([("c", "delete"), ("p", "delete"), ("c", "upsert"), ("p", "upsert")], "table_name string, operation string")
    order = [(r.table_name, r.operation) for r in cdc.drained(queue, ["p", "c"]).orderBy("turn").collect()]
    assert order == [("c", "delete"), ("p", "delete"), ("p", "upsert"), ("c", "upsert")]


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), "t", f"k{i % 4}", "delete" if i == 11 else "upsert", f"p{i}") for i in range(12)]
    schema = "event_id long, created_at timestamp, table_name string, record_key string, operation string, payload string"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = store.Store(spark, f"{tmp_path}/state")
    got = intake.apply_stream(stream, state, "t", f"{tmp_path}/ck")
    batch = spark.createDataFrame(rows, schema)
    want = cdc.applied(batch.select("table_name", "record_key", "payload").limit(0), batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = cdc.applied(want, batch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
    assert cdc.applied(want, batch, deletes=True).count() == 3


def test_streamed_events_once(spark, tmp_path):
    rows = [(i % 5, datetime.datetime(2024, 1, 1, 0, i), "click") for i in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string").parquet(f"{tmp_path}/e")
    query = intake.distinct_events(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 5


def test_outbox(spark):
    changes = spark.createDataFrame([("a", 1, 1, "upsert"), ("a", 2, 2, "archive"), ("b", 1, 3, "upsert")], "k string, ts int, id int, op string")
    queue = catalog.outbox(changes, ["k"], "op", "ts", "id")
    assert {r.k: (r.generation, r.operation) for r in queue.collect()} == {"a": (2, "delete"), "b": (1, "upsert")}
    acks = spark.createDataFrame([("a", 1), ("b", 1)], "k string, generation long")
    assert [r.k for r in catalog.acknowledged(queue, acks, ["k"]).collect()] == ["a"]


def test_no_write_is_lost(spark, tmp_path):
    """An append, and another change, that land while an upsert is at work are there afterwards, with the upsert."""
    held = store.Store(spark, str(tmp_path))
    rows = lambda pairs: spark.createDataFrame(pairs, "id long, v string")
    held.write("t", rows([(0, "a"), (1, "b")]))
    other, seen = store.Store(spark, str(tmp_path)), []

    def change(old):
        seen.append(old.count())
        if len(seen) == 1:
            other.append("t", rows([(7, "late")]))
        if len(seen) == 2:
            other.upsert("t", rows([(1, "other")]), ["id"])
        return store.merged(old, rows([(0, "new")]), ["id"])

    held.replace("t", change)
    assert sorted(map(tuple, held.read("t").collect())) == [(0, "new"), (1, "other"), (7, "late")] and seen == [2, 3, 3]
    folders = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]
    assert len(folders) == 4  # those of changes that were made anew are gone


def test_outbox_as_a_stream(spark, tmp_path):
    """Generations, attempts and acknowledgements over several micro-batches; an old acknowledgement ends nothing."""
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    deliveries = [
        [("a", "change", "upsert", at(1), 1, None), ("a", "failed", None, at(2), 2, None), ("b", "change", "upsert", at(1), 3, None), ("c", "failed", None, at(1), 9, None)],
        [("a", "change", "delete", at(5), 4, None), ("a", "sent", None, at(6), 5, 1), ("b", "sent", None, at(6), 6, 1)],
        [("a", "failed", None, at(7), 7, None), ("b", "change", "late", at(0), 8, None)],
    ]
    schema = "record string, kind string, operation string, at timestamp, event_id long, generation long"
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last = outbox.run_outbox(spark, stream, ["record"], f"{tmp_path}/out", f"{tmp_path}/offsets")
    got = {r.record: (r.generation, r.operation, r.attempts, r.pending) for r in last.collect()}
    assert got == {"a": (2, "delete", 1, True), "b": (2, "upsert", 0, True), "c": (0, None, 0, False)}


def test_outbox_takes_rows_without_frames(monkeypatch):
    """A record's rows, in several frames and out of order, are taken by time and event; those without a time last; no frame is joined or sorted for a record."""
    import pandas as pd

    from tarnwood.streaming.outbox import OutboxEntries

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    entries = OutboxEntries(["k"])
    entries.entry = State()
    at = lambda s: pd.Timestamp(f"2024-01-01 00:00:{s:02d}") if s else pd.NaT
    frame = lambda rows: pd.DataFrame([(at(s), e, kind, op, g) for s, e, kind, op, g in rows], columns=["at", "event_id", "kind", "operation", "generation"])
    frames = [frame([(9, 4, "failed", None, None), (0, 7, "sent", None, 2)]), frame([(5, 3, "change", "b", None), (5, 2, "change", "a", None)])]
    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    (out,) = entries.handleInputRows(("x",), iter(frames), None)
    assert out.iloc[0].tolist() == ["x", 2, "b", at(5), 3, 1, False]
