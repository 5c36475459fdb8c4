"""Scans over ranges, batches, digests, pruned comparison and compaction against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwood.operators import blocks, digests, mining, scans, upkeep


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Small tables stay dealt, so that carries matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def greedy(sizes: list[int], max_rows: int, max_bytes: int) -> list[int]:
    out, batch, n, total = [], 0, 0, 0
    for k, s in enumerate(sizes):
        if k and (n >= max_rows or total + s > max_bytes):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.append(batch)
    return out


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 15), st.integers(0, 5))
def test_maps_of_blocks_compose_to_the_greedy_batches(sizes, max_rows, max_bytes, more):
    """Blocks entered in the state that the maps before them leave give the batches of one pass."""
    block = max_rows + more
    entry, base, out = 0, 0, []
    for at in range(0, len(sizes), block):
        carried = min(max_rows, at)
        own = np.array(sizes[at - carried : at + block])
        after, begun = scans._map(own, carried, max_rows, max_bytes)
        out += scans._numbers(own, carried, entry, base, max_rows, max_bytes)
        entry, base = int(after[entry]), base + int(begun[entry])
    assert out == greedy(sizes, max_rows, max_bytes)


@pytest.mark.parametrize("max_rows, max_bytes, block, fan", [(3, 12, 4, 2), (25, 60, 25, 3), (1, 5, 2, 4), (7, 10_000, 8, 256)])
def test_batches(spark, max_rows, max_bytes, block, fan):
    rng = random.Random(max_rows)
    rows = [(g, i, rng.choice([None, 0, 1, 5, 9, 100])) for g, n in (("a", 230), ("b", 1), (None, 40), ("c", 26)) for i in rng.sample(range(1000), n)]
    frame = spark.createDataFrame(rows, "g string, i int, b int").withColumn("batch_", F.lit(1))
    found = scans.batches_in_order(frame.repartition(5), "i", "b", "g", max_rows, max_bytes, block=block, fan=fan)
    assert found.columns == ["g", "i", "b", "batch_", "batch"]
    got = {(r.g, r.i): r.batch for r in found.collect()}
    for g in ("a", "b", None, "c"):
        own = sorted((i, b or 0) for x, i, b in rows if x == g)
        assert [got[g, i] for i, _ in own] == greedy([b for _, b in own], max_rows, max_bytes)
    assert scans.batches_in_order(frame.limit(0), "i", "b", "g", 5, 5).collect() == []


def test_numbers_and_last_values_over_ranges(spark):
    """One key with nine tenths of all rows, a null key, keys within one range."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), i, rng.choice([None, None, f"v{i}"])) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, at int, v string").repartition(6)
    got = {r["at"]: (r.number, r.last) for r in scans.last_before(scans.numbered(frame, ["k"], ["at"]), ["k"], "at", F.col("v")).collect()}
    seen: dict = {}
    for k, at, v in rows:
        n, last = seen.get(k, (0, None))
        seen[k] = (n + 1, v or last)
        assert got[at] == seen[k]
    assert scans.in_ranges(frame, ["k"], ["at"]).where("k = 'hot'").select("part").distinct().count() > 2
    whole = {r["at"]: r.head for r in upkeep.attach_to_preceding(frame, "at", F.col("v").isNotNull(), "v").collect()}
    last = None
    for _, at, v in rows:
        last = v or last
        assert whole[at] == last
    assert scans.numbered(frame.limit(0), ["k"], ["at"]).collect() == []


def test_digest_trees(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 == 0 else i) for i in range(3000)]
    a = spark.createDataFrame(rows, "id long, v string, n long")
    b = spark.createDataFrame([(i, "changed" if i == 77 else v, n) for i, v, n in rows if i != 1234] + [(5000, "new", None)], a.schema)
    columns = ["id", "v", "n"]
    assert sorted(map(tuple, digests.tree_audit(a, b, "id", columns).collect())) == [(77, "mismatch"), (1234, "missing"), (5000, "extra")]
    here, there = (digests.digest_leaves(x.repartition(n), "id", columns) for x, n in ((a, 3), (b, 5)))
    leaves, compared = digests.differing_leaves(here, there)
    assert leaves.count() <= 3 and compared[0] == 1 and sum(compared) <= 1 + 3 * 3 * 16 and here.count() > 1500
    same, compared = digests.differing_leaves(here, digests.digest_leaves(a, "id", columns))
    assert same.count() == 0 and compared == [1, 0, 0, 0]
    assert digests.tree_audit(a, a.limit(0), "id", columns).count() == 3000 and digests.tree_audit(a.limit(0), a.limit(0), "id", columns).count() == 0


def test_far_blocks_are_not_compared(spark):
    """Narrow clusters: the pairs are those of all against all, by a small part of the pairs of blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + rng.normal(0, 0.05, (80, 16)) for c in centres] + [np.repeat(centres[:1], 200, axis=0), np.zeros((2, 16))])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(4)
    norms = np.linalg.norm(m, axis=1)
    u = m / np.where(norms > 0, norms, np.inf)[:, None]
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(np.floor(u @ u.T * 1e9 + 0.5) / 1e9 > 0.9, 1))}
    assert {(r.a, r.b) for r in blocks.similar_pairs(rows, 0.9, size=40).collect()} == want
    made = blocks.block_pairs(rows, 0.9, size=40).count()
    n = blocks._blocks(rows, 0.9, "id", "embedding", 40)[0].count()
    assert n > 20 and made < n * (n + 1) // 2 // 3
    low = {(r.a, r.b) for r in blocks.similar_pairs(rows, -0.5, size=100).collect()}
    assert low == {(int(i), int(j)) for i, j in np.argwhere(np.triu(np.floor(u @ u.T * 1e9 + 0.5) / 1e9 > -0.5, 1))}
    assert blocks.similar_pairs(rows.limit(0), 0.5).collect() == []


@pytest.mark.parametrize("split", [2000, 3])
def test_compaction_with_copies(spark, split):
    """Groups of copies, near copies and hot words; marks agree with pairs however hot words are split."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base)] * 9 + [" ".join([*base[:19], f"x{k % 3}"]) for k in range(9)] + [" ".join([*base, "rare"])] * 4
    texts += [" ".join(rng.choices(base, k=rng.randint(0, 6))) for _ in range(40)] + ["", " ", None]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, content string, session_id string")
    sets = [(i, set((t or "").split()), g) for i, t, g in rows]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for threshold in (0.9, 0.75):
        want = {(i, j) for i, a, g in sets for j, b, h in sets if i < j and g == h and alike(a, b) > threshold}
        marks = {r.a for r in mining.superseded(frame, threshold, split=split).collect()}
        assert marks == {a for a, _ in want}
        got = {(r.a, r.b) for r in mining.compaction_pairs(frame, threshold, split=split).collect()}
        assert {p for p in got if sets[p[0]][1]} == {p for p in want if sets[p[0]][1]} and {a for a, _ in got} == marks


def test_neighbours_are_sent_once_a_group(spark, monkeypatch):
    """Small groups and products, copies and equal scores: neighbours and pairs are those of all against all, each vector sent once for each group and few candidates given out."""
    monkeypatch.setattr(blocks, "_GROUP", 8 * 6 * 80)
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=(330, 6)), np.repeat(rng.normal(size=(1, 6)), 40, axis=0)]).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(3)
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1)[:, None]
    score = np.floor(np.einsum("id,jd->ij", u, u) * 1e9 + 0.5) / 1e9
    want = {(i, int(j)) for i in range(len(m)) for j in np.lexsort((np.arange(len(m)), -score[i]))[:5] if score[i, j] > 0.2 and i != j}
    found = blocks.nearest_pairs(rows, 0.2, 5, size=20)
    kept = found.collect()
    _, pairs, placed, groups = blocks._blocks(rows, 0.2, "id", "embedding", 20)
    cells = blocks._cells(pairs, placed, groups).where("k is not null").count()
    assert groups >= 4 and cells <= len(m) * (groups + 1)  # blocks meet some hundred times, vectors are sent once for each group
    assert len(kept) <= 5 * cells < (score > 0.2).sum()
    best: dict = {}
    for r in kept:
        best.setdefault(r.a, []).append((-r.score, r.b))
    assert {(a, b) for a, x in best.items() for _, b in sorted(x)[:5] if a != b} == want
    every = {(r.a, r.b) for r in blocks.similar_pairs(rows, 0.6, size=20, keep_all=True).collect()}
    assert every == {(int(i), int(j)) for i, j in np.argwhere(score > 0.6)}


def test_word_sets_meet_by_parts(spark):
    """Texts of few common words: sets nearly alike share a key, and others hardly any, however common their words are."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    sets = [set(rng.sample(vocabulary, rng.randint(1, 120))) for _ in range(150)]
    sets += [(s - set(rng.sample(sorted(s), len(s) // 40))) | {f"x{k}"} for k, s in enumerate(sets[:60])]
    rows = spark.createDataFrame([("g", bytes([k]), sorted(s)) for k, s in enumerate(sets)], "g string, s binary, words array<string>")
    keys: dict = {}
    for r in mining._part_keys(rows, 0.9).collect():
        keys.setdefault(r.key, {}).setdefault(r.s[0], []).append(r.own)
    met = {(a, b) for held in keys.values() for a in held for b in held if a < b and any(held[a] + held[b])}
    alike = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and len(x & y) / len(x | y) > 0.9}
    assert len(alike) > 30 and alike <= met
    assert len(met) < len(sets) * (len(sets) - 1) // 2 // 5  # by the rarest words nearly all of one size met
