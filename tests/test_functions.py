"""Closed-form expectations for scores, texts, vectors, markup and routing."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwood.functions import embedding, markup, scores, stemming, texts, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("days, factor", [(0, 1.0), (90, 0.5), (365, 0.1), (1000, 0.1)])
def test_decay(spark, days, factor):
    assert one(spark, scores.recency_decay(F.lit(float(days)))) == pytest.approx(factor)
    assert one(spark, scores.recency_decay(F.lit(float(days)), enabled=False)) == 1.0


def test_coherence(spark):
    assert one(spark, scores.coherence(F.lit(0.0), F.lit(5), F.lit(1.0))) == pytest.approx(1.0)
    assert one(spark, scores.coherence(F.lit(90.0), F.lit(2), F.lit(0.5))) == pytest.approx(0.48)


def test_confidence(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scores.confidence_after(none, F.lit(True))) == pytest.approx(0.55)
    assert one(spark, scores.confidence_after(F.lit(0.1), F.lit(False))) == 0.0
    assert one(spark, scores.confidence_after(F.lit(0.99), F.lit(True))) == 1.0
    assert one(spark, scores.confidence_decayed(F.lit(0.8), F.lit(30.0))) == pytest.approx(0.4)
    assert one(spark, scores.confidence_decayed(F.lit(0.8), F.lit(0.5))) == 0.8


def test_rounding_and_terms(spark):
    assert one(spark, scores.round_half_up(scores.rrf_term(F.lit(1), 0.6))) == 0.0286
    assert one(spark, scores.rrf_term(F.lit(None).cast("int"), 0.6)) == 0.0
    assert one(spark, scores.round_half_up(F.lit(0.00005))) == 0.0001


@pytest.mark.parametrize("a, b, s", [("a b c", "a b c", 1.0), ("a b c", "d e f", 0.0), ("a b c", "a b d", 0.5), ("", "", 1.0), ("a b c", "", 0.0)])
def test_jaccard(spark, a, b, s):
    assert one(spark, texts.jaccard(texts.word_set(F.lit(a)), texts.word_set(F.lit(b)))) == s


def test_previews(spark):
    assert one(spark, texts.preview(F.lit("hello"), 10)) == "hello" and one(spark, texts.preview(F.lit("a" * 10), 10)) == "a" * 10
    cut = one(spark, texts.preview(F.lit("a" * 200), 10))
    assert len(cut) == 13 and cut.endswith("...")
    assert one(spark, texts.preview_within(F.lit("a" * 200), 10)) == "a" * 9 + "..."


def test_trigrams(spark):
    assert sorted(one(spark, texts.trigrams(F.lit("Cat")))) == ["  c", " ca", "at ", "cat"]
    assert one(spark, texts.trigram_similarity(F.lit("cat"), F.lit("cat"))) == 1.0
    assert one(spark, texts.trigram_similarity(F.lit(""), F.lit(""))) == 0.0


def test_vectors(spark):
    for text in ("[0.1,0.2,0.3]", "'[0.1,0.2,0.3]'", "0.1,0.2,0.3"):
        assert one(spark, vectors.parse_vector(F.lit(text))) == pytest.approx([0.1, 0.2, 0.3])
    assert one(spark, vectors.parse_vector(F.lit("[]"))) == []
    assert one(spark, vectors.format_vector(F.array(F.lit(1.0), F.lit(2.5)))) == "[1,2.5]"
    assert one(spark, vectors.cosine(vectors.constant([1, 0]), vectors.constant([0, 0]))) is None
    assert one(spark, vectors.unit(vectors.constant([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.cosine(vectors.constant([1, 1]), vectors.constant([2, 2]))) == pytest.approx(1)


@pytest.mark.parametrize(
    "raw, fields, body",
    [
        ("---\ntitle: My Note\ntags: rust, memory\n---\n\n# Heading\nContent here.", {"title": "My Note", "tags": "rust, memory"}, "# Heading\nContent here."),
        ("---\ncount: 42\nscore: 0.95\nactive: true\n---\n\nBody.", {"count": 42, "score": 0.95, "active": True}, "Body."),
        ("# Just a heading\nSome content.", {}, "# Just a heading\nSome content."), ("---\n---\nBody.", {}, "Body."),
    ],
)
def test_frontmatter(raw, fields, body):
    got = markup.split_frontmatter(raw)
    assert got[0] == fields and got[1].strip() == body


@pytest.mark.parametrize(
    "body, want",
    [
        ("Some text without headers.", [("Untitled", "Some text without headers.")]),
        ("## Intro\nIntro text.\n\n## Body\nBody text.\n\n## Conclusion\nEnd text.", [("Intro", "Intro text."), ("Body", "Body text."), ("Conclusion", "End text.")]),
        ("### Step 1\nFirst step.\n\n### Step 2\nSecond step.", [("Step 1", "First step."), ("Step 2", "Second step.")]),
        ("## Section\nTop text.\n\n### Sub A\nSub A text.\n\n### Sub B\nSub B text.", [("Section", "Top text."), ("Sub A", "Sub A text."), ("Sub B", "Sub B text.")]),
        ("", []), ("## Empty\n\n## Full\nx", [("Full", "x")]), ("```\n## not a heading\n```", [("Untitled", "## not a heading")]),
    ],
)
def test_chunks(body, want):
    assert markup.chunks(body) == want


def test_markup_columns(spark):
    rows = spark.createDataFrame([("notes/a.md", "---\nk: 1\n---\n# Top\n## S\nx\n")], "path string, text string")
    parsed = rows.withColumn("f", markup.frontmatter("text")).select("path", "f.*")
    got = parsed.select(markup.title(F.col("body"), F.col("path")).alias("t"), markup.markdown_chunks("body").alias("c"), "frontmatter").first()
    assert got.t == "Top" and got.frontmatter == '{"k": 1}' and [(c.heading, c.text) for c in got.c] == [("Untitled", "Top"), ("S", "x")]


def test_labels_and_routes(spark):
    table = lambda k: one(spark, texts.event_target(F.lit(k)))
    assert [table(k) for k in ("memory_store", "insight", "task_complete", "trade_opened", "backtest_complete")] == ["memories", "memories", "experiences", "trading_results", "trading_results"]
    assert one(spark, texts.vault_section(F.lit("notes/rust.md"))) == "notes" and one(spark, texts.vault_section(F.lit("README.md"))) == "README.md"
    assert one(spark, texts.vault_section_or_null(F.lit("README.md"))) is None
    assert one(spark, texts.uri("vault", F.lit("/a/b.md"))) == "vault://a/b.md"
    label = lambda p, m=None: one(spark, texts.source_label(F.lit(p), F.lit(m).cast("string")))
    assert [label("codex://x"), label("x", '{"source":"vault-2"}'), label("log://opencode/1"), label("a/browser/b"), label("z")] == ["Codex", "Vault", "OpenCode", "Generated browser output", "Other"]
    act = lambda *a: one(spark, texts.next_action(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), F.lit(a[3])))
    assert [act(True, False, 1, 1), act(False, False, 1, 1), act(False, True, 1, 1), act(False, True, 0, 1), act(False, True, 0, 0)] == ["paused", "unreachable", "push", "retry", "idle"]
    mode = lambda h, e: one(spark, texts.retrieval_mode(F.lit(h), F.lit(e)))
    assert [mode(False, True), mode(True, True), mode(True, False)] == ["degraded", "semantic", "keyword-only"]
    assert one(spark, texts.agent_name(F.lit('{"name":"bob"}'))) == "bob" and one(spark, texts.agent_name(F.lit("x" * 50))) == "agent"
    assert one(spark, texts.model_name(F.lit('{"modelID":"m-1"}'))) == "m-1" and one(spark, texts.model_name(F.lit("x" * 70))) == "unknown"


def test_antonyms(spark):
    assert len(texts.ANTONYMS) == 30
    assert one(spark, texts.contradiction_signals(F.lit("We should buy and go up"), F.lit("sell, it went DOWN"))) == 2
    assert one(spark, texts.contradiction_signals(F.lit("same"), F.lit("same"))) == 0


def test_age(spark):
    days = scores.age_days(F.lit(datetime.datetime(2024, 1, 1)), F.lit(datetime.datetime(2024, 1, 2, 12)))
    assert one(spark, days) == 1.5


def test_embedder(spark):
    with pytest.raises(ValueError):
        embedding.hashed_vector("  ")
    rows = spark.createDataFrame([("a b",), ("a b",), (" ",), (None,)], "t string").select(embedding.embedder(16)("t").alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 16 and sum(x * x for x in rows[0].v) == pytest.approx(1, abs=1e-5)
    assert rows[2].v is None and rows[3].v is None


@pytest.mark.parametrize(
    "word, want",
    [
        ("running", "run"), ("runs", "run"), ("hopping", "hop"), ("hoping", "hope"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("gas", "gas"),
        ("agreed", "agre"), ("luxuriated", "luxuri"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("communication", "communic"),
        ("national", "nation"), ("hopefulness", "hope"), ("knightly", "knight"), ("controlling", "control"), ("databases", "databas"), ("cry", "cri"), ("by", "by"), ("say", "say"),
        ("boyish", "boyish"), ("dying", "die"), ("news", "news"), ("exceeding", "exceed"), ("analogies", "analog"), ("replacement", "replac"), ("rate", "rate"), ("x86", "x86"), ("", ""),
    ],
)
def test_stems(word, want):
    assert stemming.stem(word) == want == stemming.stem(want) or word != want and stemming.stem(word) == want


def test_opposites_are_bits(spark):
    """Bits of two texts count what looking for each word does, words inside others included; a null text says nothing."""
    rng = random.Random(6)
    words = [w for pair in texts.ANTONYMS for w in pair] + ["x", "Buyers", "UPWARDS"]
    rows = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)] + [(60, None)], "id int, text string")
    bits = texts.with_opposites(rows, "text")
    a, b = (bits.select(*[F.col(c).alias(f"{c}_{x}") for c in bits.columns]) for x in "ab")
    both = a.crossJoin(b).select(
        texts.opposite_signals(*[F.col(c) for c in ("left_words_a", "right_words_a", "left_words_b", "right_words_b")]).alias("bits"),
        texts.contradiction_signals(F.col("text_a"), F.col("text_b")).alias("plain"),
    ).collect()
    assert all(r.bits == (r.plain or 0) for r in both) and len({r.bits for r in both}) > 3


def test_frontmatter_takes_some_texts_at_a_time():
    """A batch of texts gives what each gives alone; no more than a slice of it is taken out of Arrow at once."""
    import pyarrow as pa

    sizes = []

    class Counted:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, low, n):
            sizes.append(n)
            return self.values.slice(low, n)

    raw = [f"---\nn: {k}\n---\nbody {k}" for k in range(700)] + [None, "plain"]
    got = markup.frontmatter.func(Counted(pa.array(raw))).to_pylist()
    assert [(json.loads(r["frontmatter"]), r["body"]) for r in got] == [markup.split_frontmatter(x or "") for x in raw]
    assert len(sizes) > 2 and max(sizes) <= 256
    assert len(markup.frontmatter.func(pa.array([], pa.string()))) == 0
