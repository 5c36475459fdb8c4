"""Packing and token counts against the tokenizers library."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwood.llm.packing import PieceCoder, SumOfSquares, pack_documents
from tarnwood.llm.token_counts import CountingTokenizer, count_tokens

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def test_packing_is_an_exact_round_trip(docs):
    tok = Tokenizer.from_file(BYTES)
    given_ = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in given_)
    pieces, fills = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, BYTES, window=256).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id or -1].append((r.start, ids, r.doc_tokens))
        fills[r.sequence_id].append((r.offset, r.length))
    for spans in fills.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in s) for s in fills.values()) > 0.9 * 256 * (len(fills) - 3)
    for doc, parts in pieces.items():
        mine = [list(ids) for d, ids in want if d == doc]
        total = sum(map(len, mine))
        assert sum(len(i) for _, i, _ in parts) == total
        if len(mine) == 1:
            assert [x for _, i, _ in sorted(parts) for x in i] == mine[0] and {n for *_, n in parts} == {total}


def test_packing_of_nothing(none):
    assert pack_documents(none, BYTES).collect() == []


def test_level_choice_minimises_the_sum_of_squares():
    rng, levels = np.random.default_rng(1), SumOfSquares(40)
    for _ in range(400):
        size = int(rng.integers(1, 40))
        before = levels.counts.copy()
        options = {}
        for level in [0, *np.flatnonzero(before)]:
            if level + size <= 40:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 40
                options[int(level)] = int((after**2).sum())
        chosen = levels.level_for(size)
        assert options[chosen] == min(options.values())
        levels.place((1,), size)
        assert levels.counts[0] == levels.counts[40] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_open_windows_are_filled_up(sizes):
    """Every token lies in one piece, the windows that stay keep their pieces, and less than a window is padded."""
    levels, closed = SumOfSquares(64), []
    for doc, n in enumerate(sizes):
        full = levels.place((doc, 0, np.arange(n, dtype="<u4").tobytes(), n), n)
        closed += [full] if full else []
    before = [content[:] for contents in levels.open.values() for content in contents]
    finished = levels.finish()
    found, fills = defaultdict(list), []
    for content in closed + finished:
        fills.append(sum(len(p[2]) // 4 for p in content))
        for doc, start, ids, total in content:
            found[doc].append((start, np.frombuffer(ids, "<u4").tolist()))
            assert total == sizes[doc]
    assert {d: [x for s, ids in sorted(parts) for x in ids] for d, parts in found.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    assert all(s == ids[0] for parts in found.values() for s, ids in parts)
    assert max(fills, default=0) <= 64 and sum(64 - f for f in fills) < 64
    assert sum(any(f[: len(b)] == b for b in before) for f in finished) == len(finished)
    assert not levels.open and not levels.counts.any()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_has_the_library_s_ids_and_count(text):
    assert np.frombuffer(CODER.encode(text), "<u4").tolist() == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
    for mine in (COUNTER.count, lambda t: COUNTER.count(t, 3)):
        assert mine(text) == len(LIBRARY[WORDS].encode(text, add_special_tokens=False).ids)


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
CODER, COUNTER = PieceCoder(BYTES), CountingTokenizer(WORDS)


def test_coder_keeps_its_ids_when_generations_change():
    small, text = PieceCoder(BYTES, capacity=3), "the cat, the dog, the bird and the cat again."
    assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
    small.fast = None
    assert np.frombuffer(small.encode(text + " another"), "<u4").tolist() == LIBRARY[BYTES].encode(text + " another", add_special_tokens=False).ids


def test_counts(docs, none):
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, WORDS, limit=50).collect())
    want = []
    for r in docs.collect():
        n = len(LIBRARY[WORDS].encode(r.text or "", add_special_tokens=False).ids)
        want.append(((r.doc_id or -1), len((r.text or "").encode()), n, n > 50))
    assert got == sorted(want)
    assert count_tokens(none, WORDS).collect() == []


def test_state_maps_compose_in_any_grouping():
    text = "It's a <|endoftext|> test of chunks, don't you think? " * 3
    maps = [COUNTER.chunk(text[i : i + 5]) for i in range(0, len(text), 5)]
    left = maps[0]
    for m in maps[1:]:
        left = COUNTER.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = COUNTER.compose(m, right)
    assert left == right
