"""The driver contract, and every query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tarnwood.operators import retrieval
from tarnwood.plans import fixtures
from tarnwood.plans import queries as plans

from .compare import compare, connect


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["id", "score", "vec_rank", "kw_rank"] and found.count() == 10


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, small, name):
    run, sql = plans.queries()[name], plans.oracle_sql().get(name)
    if sql is None:
        assert run(spark, small).count() > 0
    else:
        assert compare(spark, connect(small), small, run, sql) == ""


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_twin_is_not_empty(name):
    assert connect("/root/testdata/sf0.01").execute(plans.oracle_sql()[name]).fetchone() is not None


def test_hybrid_has_both_sides(spark):
    """With weights of 0.6 and 0.4 the first row of the keyword side alone comes after ten or more of the vector side."""
    sf = "/root/testdata/sf0.01"
    rows, vectors, vector = fixtures.memories(spark, sf), fixtures.vectors(spark, sf), fixtures.query_vector(spark, sf)
    found = retrieval.hybrid_search(rows, vectors, plans.QUERY, vector, "hybrid", 14).collect()
    assert any(r.kw_rank and not r.vec_rank for r in found) and any(r.vec_rank and not r.kw_rank for r in found)


@pytest.mark.parametrize("name", ["ret05_rrf", "ret06_rsf"])
def test_fusion_has_both_sides(spark, name):
    found = plans.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert any(r.vec_rank and r.kw_rank for r in found) and any(r.kw_rank and not r.vec_rank for r in found) and any(r.vec_rank and not r.kw_rank for r in found)
