"""Hard negatives against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwood.llm.hard_negatives import Best, mine_hard_negatives, open_products

SCHEMA = "vec_id long, embedding array<float>, label int, score double, anchor string, place int"


def plain(rows: list[tuple], every: int = 50) -> list[tuple]:
    """By the definition, over all pairs."""
    clean = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in clean:
        if a[0] % every:
            continue
        near = sorted(((-score(a, b), b[0]) for b in clean if b[1] == a[1] and b[0] != a[0]))[:5]
        for s, p in near:
            fits = sorted((-score(a, b), b[0]) for b in clean if b[1] != a[1] and 50 * -s <= 100 * score(a, b) <= 95 * -s)[:3]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def vectors(rng: random.Random, n: int, dim: int = 6) -> list[tuple]:
    return [(i, [rng.gauss(0, 1) for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA)


def test_plain_loops(spark):
    """Ties, repeated vectors, nulls, non-finite components, short and empty vectors, huge and tiny ones, clashing names."""
    rows = vectors(random.Random(1), 400)
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(30)] + [(2000 + 50 * i, rows[i][1][:3], 1) for i in range(4)]
    rows += [(3000, [], 1), (3050, [0.0] * 6, 2), (3100, [50.0, -900.0, 3e4, 0.0, 1.0, -2.0], 0), (3101, [1e-9] * 6, 0)]
    rows += [(None, rows[0][1], 1), (3150, None, 1), (3200, rows[1][1], None), (3250, [1.0, None], 1), (3300, [float("nan")] * 6, 1), (3350, [float("inf")] * 6, 0)]
    want = plain(rows)
    assert want and {r[0] for r in want} >= {0, 50, 3100}
    for parts in (1, 5):
        found = mine_hard_negatives(frame(spark, rows).repartition(parts)).collect()
        assert sorted(map(tuple, found)) == want


def test_passes_and_repeats(spark):
    """Many small passes give what one does; a repeated anchor has its rows twice; few rows have fewer places."""
    rows = vectors(random.Random(2), 120)
    once = mine_hard_negatives(frame(spark, rows), anchors=F.col("vec_id") % 10 == 0)
    many = mine_hard_negatives(frame(spark, rows).repartition(4), anchors=F.col("vec_id") % 10 == 0, pass_bytes=1)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, many.collect())) == plain(rows, 10)
    few = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.7, 0.6], 2), (2, [0.7, 0.6], 2)]
    found = sorted(map(tuple, mine_hard_negatives(frame(spark, few)).collect()))
    assert found == plain(few) and len(found) == 4


def test_nothing(spark):
    assert mine_hard_negatives(frame(spark, [])).collect() == []
    assert mine_hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])).collect() == []  # no positive
    assert mine_hard_negatives(frame(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)])).collect() == []  # a negative score has no band
    with pytest.raises(Exception, match="64 bits"):
        mine_hard_negatives(frame(spark, [(0, [1e30], 1), (1, [1e30], 1)])).collect()


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 300, 70_000, 2**26]), st.booleans())
def test_no_pair_is_lost_by_its_interval(seed, size, sparse):
    """What stays is exactly what qualifies by its whole product, and products are exact."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (7, 5)), rng.integers(-size, size, (40, 5))
    whole = a @ b.T
    cut = np.quantile(whole, 0.99 if sparse else 0.3)
    x, y, product = open_products(a, b, lambda low, high, k: high >= cut, np.ones((7, 40), bool))
    assert set(zip(x.tolist(), y.tolist(), product.tolist())) == {(i, j, int(whole[i, j])) for i, j in zip(*np.nonzero(whole >= cut))}


def test_rows_leave_before_the_last_plane():
    """Most pairs are dropped on the first planes."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(-100, 100, (20, 64)), rng.integers(-100, 100, (500, 64))
    seen, cut = [], np.quantile(a @ b.T, 0.999)

    def useful(low, high, k):
        seen.append(int(np.count_nonzero(high >= cut)))
        return high >= cut

    open_products(a, b, useful, np.ones((20, 500), bool))
    assert seen[0] == 10_000 and seen == sorted(seen, reverse=True) and seen[3] < 2_000 and seen[-1] <= 20


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 3, 4]))
    best.add(np.array([0, 0]), np.array([5, 4]), np.array([1, 0]))
    assert list(zip(best.key.tolist(), best.score.tolist(), best.id.tolist())) == [(0, 5, 1), (0, 5, 3), (1, 1, 4)] and best.last[0] == 5
