"""Stems, proximity rank, and the index against a scan."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwood.functions.stemming import STOP, stem
from tarnwood.operators import retrieval, textindex
from tarnwood.operators.textindex import TextIndex, fts_topk, keyword_topk, most_rank, text_rank, trigram_topk

WORDS = ["run", "running", "runs", "hop", "hopping", "hops", "walk", "walked", "the", "of", "x9", "relational", "relate", "cat", "cats"]


def corpus(spark, n: int, longest: int = 25):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, longest)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "Running, HOPPING!"), (n + 3, "run " * 400 + "hop"), (n + 4, "café runs")]
    return spark.createDataFrame(rows, "id long, content string"), rows


def plain(rows: list[tuple], query: str) -> dict[int, float]:
    """Every pair of places spelled out."""
    wanted = sorted({stem(w) for w in query.lower().split() if w not in STOP})
    out = {}
    for i, text in rows:
        words, at = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split(), {}
        for place, w in enumerate(words, 1):
            if w not in STOP and stem(w) in wanted:
                at.setdefault(stem(w), []).append(place)
        if wanted and len(at) == len(wanted):
            places = [at[s][:255] for s in wanted]
            if len(places) == 1:
                r = sum(0.1 / k**2 for k in range(1, len(places[0]) + 1)) / 1.64493406685
            else:
                r = 1.0
                for k, a in enumerate(places):
                    for b in places[k + 1 :]:
                        for x in a:
                            for y in b:
                                d = abs(x - y)
                                r *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
                r = 1 - r
            out[i] = r / (r + 1)
    return out


@pytest.mark.parametrize("query", ["run", "the running of hops", "relating cat walks", "x9", "nothing here", "the of", ""])
def test_scan_and_index_agree_with_plain_loops(spark, tmp_path, query):
    docs, rows = corpus(spark, 150)
    want = sorted(((-round(s, 9), i) for i, s in plain(rows, query).items()))[:12]
    found = [(-r.score, r.id) for r in fts_topk(docs.repartition(3), query, 12).collect()]
    assert [i for _, i in found] == [i for _, i in want] and [s for s, _ in found] == pytest.approx([s for s, _ in want], abs=2e-9)
    index = TextIndex(spark, f"{tmp_path}/index", buckets=8).build(docs, block_docs=16, grams=False)
    assert index.search(query, 12).collect() == fts_topk(docs, query, 12).collect()


def test_forms_of_a_word_are_found(spark):
    docs = spark.createDataFrame([(1, "they run"), (2, "running"), (3, "a runner"), (4, "runs far")], "id long, content string")
    assert {r.id for r in fts_topk(docs, "running", 9).collect()} == {1, 2, 4}


def test_search_reads_its_buckets_and_no_needless_blocks(spark, tmp_path, monkeypatch):
    """A few documents hold the words side by side, the others once and far apart: only the former's blocks are ranked."""
    rng = random.Random(2)
    far = lambda: "run " + "x9 " * 40 + "hop"
    rows = [(i, "run hop " * 12 if i % 211 == 0 else far()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "id long, content string")
    index = TextIndex(spark, f"{tmp_path}/index", buckets=16).build(docs, block_docs=8, grams=False)
    monkeypatch.setattr(textindex, "_FIRST", 12)
    found = index.search("running hops", 5)
    assert [r.id for r in found.collect()] == [0, 211, 422, 633, 844]
    bounds = {r.block: r.bound for r in index.bounds("running hops").collect()}
    assert len(bounds) > 150 and sum(b >= found.first().score for b in bounds.values()) <= 12
    scan = index._postings(["hop", "run"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "bucket#" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "docs" not in index.bounds("run hop")._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split("\n")[0]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sets(st.integers(1, 300), min_size=1, max_size=20), min_size=1, max_size=3))
def test_bounds_hold(places):
    """No text ranks more than its counts allow, and a rank is a share."""
    lists = [sorted(p) for p in places]
    assert 0 <= text_rank(lists) <= most_rank([len(p) for p in lists]) + 1e-12


def test_trigrams(spark, tmp_path):
    rng = random.Random(3)
    syllables = ["ba", "ko", "ri", "mun", "tel", "os"]
    names = [" ".join("".join(rng.choices(syllables, k=3)) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["", "??"]
    docs = spark.createDataFrame([*enumerate(names), (900, None)], "id long, content string")
    index = TextIndex(spark, f"{tmp_path}/index", buckets=8).build(docs, block_docs=32)
    for query in (names[5], "bakori", "koritel os", "zzz", "", "??"):
        for least in (0.3, 0.55):
            want = trigram_topk(docs, query, 30, least=least).collect()
            assert index.similar(query, 30, least).collect() == want
            assert {r.id for r in index.candidates(query, least).collect()} >= {r.id for r in want}
    assert index.candidates(names[5], 0.55).count() < 200
    assert index.keyword("bakori kooo", 5).collect() == keyword_topk(docs, "bakori kooo", 5).collect() != []


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "id string, content string")
    index = TextIndex(spark, f"{tmp_path}/index").build(none)
    assert index.search("run", 5).collect() == index.similar("run", 5).collect() == index.keyword("run", 5).collect() == []
    assert retrieval.ranked(fts_topk(none, "run", 5)).collect() == []


def test_index_is_dealt_once(spark, tmp_path):
    """Postings are grouped where they are dealt for writing: one exchange of them in the plan, not two."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7}") for i in range(50)], "id long, content string")
    index = textindex.TextIndex(spark, str(tmp_path / "index"), 4).build(docs, block_docs=8)
    rows = docs.select("id", F.lit(0).alias("block"), F.explode(F.split("content", " ")).alias("term"))
    grouped = index._dealt(rows, "term").groupBy("slot", "bucket", "term", "block").agg(F.collect_list("id").alias("docs"))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    stored = spark.read.parquet(f"{index.path}/words")
    assert "slot" not in stored.columns and stored.groupBy("term").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0
    assert [tuple(r) for r in index.search("alpha w3", 9).collect()] == [tuple(r) for r in textindex.fts_topk(docs, "alpha w3", 9).collect()]


def test_a_scan_keeps_few_stems(spark, monkeypatch):
    """What a task knows of words is bounded, and results do not depend on it."""
    docs = spark.createDataFrame([(i, f"alpha v{i} beta u{i % 9}") for i in range(60)], "id long, content string")
    want = textindex.fts_topk(docs, "alpha beta", 60).collect()
    assert textindex._KNOWN <= 1 << 16
    monkeypatch.setattr(textindex, "_KNOWN", 2)
    assert textindex.fts_topk(docs, "alpha beta", 60).collect() == want
