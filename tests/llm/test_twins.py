"""The registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import pytest

from tarnwood.llm.queries import oracle_sql, queries
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, small, name):
    assert compare(spark, connect(small), small, queries()[name], oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_whole_table(spark, small, name):
    found = queries()[name](spark, small)
    docs = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in found.select("doc_id").collect()} == docs
