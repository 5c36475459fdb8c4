"""Phrase collocations against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tarnwood.llm import phrases
from tarnwood.llm.phrases import mine_phrases

SCHEMA = "text string, lang string, phrase string, n long, piece string, m int"


def plain(rows: list[tuple], least: int = 30, top: int = 2000) -> list[tuple]:
    """By the definition, every phrase spelled out."""
    out, by = [], {}
    for text, lang in rows:
        by.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in by.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows: list[tuple], parts: int = 3, **how) -> list[tuple]:
    frame = spark.createDataFrame([(t, lang, "x", 1, "y", 2) for t, lang in rows], SCHEMA)
    return sorted(map(tuple, mine_phrases(frame.repartition(parts), **how).collect()))


def texts(rng: random.Random) -> list[tuple]:
    words = ["Ka", "lo", "mi", "ten", "é", "ra x", "su", "日本", "\x00", "a\x1cb", "ΑΣ"]
    rows = [(" ".join(rng.choices(words, weights=range(11, 0, -1), k=rng.randint(0, 12))) + rng.choice([".", "\n", "  \t", "", ", x"]), rng.choice(["en", "en", "de", None])) for _ in range(700)]
    rows += [("new york stock exchange! new york. york new", "en")] * 45 + [("the same line again and again", None)] * 29 + [("THE same line", "und")] * 2
    return [*rows, (None, "en"), ("", None), (" \t\n ", "fr"), ("only here", "es"), ("long " * 200_000 + "tail", "xx"), ("a b " * 40, "")]


def test_plain_loops(spark):
    rows = texts(random.Random(4))
    want = plain(rows)
    assert found(spark, rows) == want and {r[0] for r in want} == {"en", "de", "und", "xx", ""}
    assert found(spark, rows, 1, least=5, top=7) == plain(rows, 5, 7)


def test_small_task_memory(spark, monkeypatch):
    """Counts given out after every few words, small fields and batches change nothing."""
    rows = texts(random.Random(5))
    want = plain(rows)
    seen = {}
    for name, value in (("_BYTES", 20), ("_ROWS", 3)):
        monkeypatch.setattr(phrases, name, value)
    pieces = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "piece": ["a b a b c", "a b"], "m": [2, 5]})
    for batch in phrases._sequences(1, 1, None)(iter([pieces])):
        for r in batch.to_pylist():
            seen[r["lang"], r["phrase"]] = seen.get((r["lang"], r["phrase"]), 0) + r["n"]
    assert seen == {("en", "a"): 4, ("en", "b"): 4, ("en", "c"): 2, ("de", "a"): 5, ("de", "b"): 5}
    monkeypatch.undo()
    assert found(spark, rows, 7) == want


def test_longer_sequences_need_frequent_parts():
    """Only sequences whose parts are in the field are counted; a full field lets all through."""
    class Field:
        value = np.full(phrases._CELLS, np.uint64(2**64 - 1))

    pieces = pa.RecordBatch.from_pydict({"lang": ["en"], "piece": ["a b c d e"], "m": [3]})
    run = lambda first, last, field: [r["phrase"] for b in phrases._sequences(first, last, field)(iter([pieces])) for r in b.to_pylist()]
    assert sorted(run(3, 4, Field)) == ["a b c", "a b c d", "b c d", "b c d e", "c d e"] and sorted(run(2, 2, Field)) == ["a b", "b c", "c d", "d e"]
    words = phrases.xxhash.xxh3_64_intdigest
    field = np.zeros(phrases._CELLS, np.uint64)
    for word in "bcd":
        h = words(f"en\t{word}")
        field[h & (phrases._CELLS - 1)] |= np.uint64(1 << (h >> 20 & 63))
    Some = type("Some", (), {"value": field})
    assert sorted(run(2, 2, Some)) == ["b c", "c d"]


def test_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("one two", "en")]) == []


def test_exact_beyond_64_bits(spark):
    """Products of counts do not overflow."""
    big = 2**62
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big)], "lang string, phrase string, f long")
    candidates = counts.where("phrase = 'a b'").withColumnRenamed("f", "a")
    assert phrases._cuts(candidates, counts, 4).first().score == 1_000_000
    longer = candidates.unionByName(spark.createDataFrame([("en", "a b c", big * 79 // 100)], "lang string, phrase string, a long"))
    assert phrases._freestanding(longer, 80, 4).count() == 2 and phrases._freestanding(longer, 79, 4).count() == 2 - (100 * (big * 79 // 100) >= 79 * big)
