"""The engine's calls, end to end on a small store."""

from __future__ import annotations

import datetime

import pytest

from tarnwood.engine import Engine
from tarnwood.functions.embedding import hashed_vector

NOW = datetime.datetime(2024, 1, 1)


def test_calls(spark, tmp_path):
    e = Engine(spark, str(tmp_path), lambda t: hashed_vector(t, 32).tolist())
    session = e.session_start("learn", NOW)
    a, b = e.memory_initialize(["the red fox runs", "a blue whale swims", "the red fox runs"], NOW)
    assert e.memory_initialize(["a blue whale swims"], NOW) == []
    critical = e.memory_store("never forget the red key", NOW, critical=True)
    found = e.memory_search("red fox", 5, session_id=session, now=NOW).collect()
    assert found[0].id == a and found[0].source_table == "memories"
    assert e.memory_search("whale", 5, "keyword").first().id == b
    assert {r.source_id for r in e.session_context(session).collect()} == {r.id for r in found}
    assert {r.section for r in e.memory_context("red fox").collect()} >= {"keyword", "similar", "sessions"}
    assert e.recall(critical).first().source_table == "memories" and e.recall("?").collect() == []
    e.forget(b)
    kept = {r.id: r for r in e.list("memories").collect()}
    assert kept[b].importance == 0 and kept[b].tags == ["forgotten"] and kept[critical].importance == 0.9
    p = e.procedure_create("Deploy", "put it out", "[]", NOW)
    with pytest.raises(ValueError):
        e.procedure_create("Deploy", "", "", NOW)
    e.procedure_ran(p, True)
    e.procedure_ran(p, False)
    ran = e.procedure_run("dEpLoY").first()
    assert (ran.times_used, ran.success_rate) == (2, 0.5) and e.procedure_search("PUT").count() == 1
    x = e.experience_store("fix the build", "success", NOW)
    e.experience_outcome(x, True)
    assert e.experience_find("build").first().confidence == pytest.approx(0.55)
    e.session_end(session, "done", NOW)
    assert e.table("sessions").first().status == "completed"
    assert {r.label: r.n for r in e.status().collect()}["memories"] == 3
    assert {r.label: r.missing for r in e.memory_health(32).collect()} == {"memories": 0, "documents": 0, "experiences": 1, "all": 1}
    assert e.archive_status().first().n == 3 and e.storage_catalog().count() == 1
    e.dashboard_control("pause")
    assert e.dashboard_status(1, 0).first().next_action == "paused"
    again = e.memory_store("the red fox runs", NOW, session_id=session)
    e.memory_store("the red fox runs", NOW, session_id=session)
    e.session_compact(session)
    assert sorted(r.importance for r in e.table("memories").where(f"session_id = '{session}'").collect()) == [0.0, 0.5] and again


def test_keyword_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.memory_store("plain words", NOW)
    assert e.memory_search("plain").count() == 1


def test_search_over_an_index(spark, tmp_path):
    """An index gives what a scan gives, in any form of a word, until the table changes."""
    engine = Engine(spark, str(tmp_path))
    now = datetime.datetime(2024, 1, 1)
    for text in ("a fox runs", "the fox was running far", "hens sleep"):
        engine.memory_store(text, now)
    scan = engine.memory_search("running fox", 5).collect()
    engine.index_texts("memories")
    assert engine._index("memories") is not None and engine.memory_search("running fox", 5).collect() == scan and len(scan) == 2
    engine.memory_store("fox run", now)
    assert engine._index("memories") is None and len(engine.memory_search("running fox", 5).collect()) == 3
