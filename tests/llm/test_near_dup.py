"""Near-duplicates against all pairs of full shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnwood.llm import near_dup, shingles
from tarnwood.llm.components import components
from tarnwood.llm.near_dup import near_duplicates
from tarnwood.llm.shingles import CirculantMinHash

from .conftest import words


def brute(rows: list[tuple], width: int, percent: int = 80) -> dict:
    """doc_id -> (size, component)."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {d: lo if g == hi else g for d, g in group.items()}
    return {d: (len(sets[d]), group[d]) for d in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(docs, width):
    named = docs.where("doc_id is not null")
    want = brute([(r.doc_id, r.text) for r in named.collect()], width)
    got = near_duplicates(docs, width=width).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_BLOCK", 7)
    rng = random.Random(3)
    base = words(rng, 80).split()
    rows = []
    for i in range(90):
        text = list(base)
        for at in rng.sample(range(80), rng.randint(0, 12)):
            text[at] = rng.choice(base) if i % 2 else words(rng, 1)
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    want = brute(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 1


def test_blocks_without_a_common_bucket_are_not_paired(spark, monkeypatch):
    """A chain whose neighbours share three fifths of their text: one family, but few blocks that touch."""
    rng = random.Random(8)
    line = words(rng, 40 * 60 + 90).split()
    rows = [(i, " ".join(line[40 * i : 40 * i + 130])) for i in range(60)]
    monkeypatch.setattr(near_dup, "_BLOCK", 3)
    want = {d: c for d, (_, c) in brute(rows, 2).items()}
    made = []

    def counted(percent):
        def work(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([-1] * batch.num_rows, pa.int64())] * 2, names=["a", "b"])

        return work

    settled = near_dup.settle
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, width=2).collect()} == want == {i: i for i in range(60)}
    monkeypatch.setattr(near_dup, "_block_comparer", counted)
    monkeypatch.setattr(near_dup, "settle", lambda df: (made.append(df.where("a = -1").count()) if df.columns == ["a", "b"] else None, settled(df))[1])
    near_duplicates(docs, width=2).collect()
    assert 10 < max(made) < 20 * 21 / 4


def test_signatures_come_from_two_permutations():
    """On few numbers the shifted permutation is told apart from the first by its values."""
    minhash = CirculantMinHash(2, 3)
    for value in (1, 7, 123_456_789, 2**32 - 1):
        low = np.array([value], np.uint32)
        first = shingles._permuted(low.copy(), shingles._FIRST)
        want = [shingles._permuted(first - np.uint32(k), shingles._SECOND)[0] for k in range(6)]
        assert list(minhash.signature(np.array([value], np.uint64))) == want
        assert first[0] != shingles._permuted(low.copy(), shingles._SECOND)[0]
    for by in (shingles._FIRST, shingles._SECOND):
        assert len(np.unique(shingles._permuted(np.arange(1 << 20, dtype=np.uint32), by))) == 1 << 20


def test_nothing(none):
    assert near_duplicates(none).collect() == []


def test_components_of_any_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    group = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for a, b in links:
        if a != b and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = {n: lo if g == hi else g for n, g in group.items()}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.node: r.label for r in got} == group and len(got) == len(group)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
