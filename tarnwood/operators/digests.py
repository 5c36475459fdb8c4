"""Comparing two copies of a table by a tree of digests.

Keys are dealt over the leaves of a tree by their hash. A node's digest is the
number of its rows and the sum of their digests in four parts, so it is added up
before anything is shuffled, does not depend on order, and a parent's is the sum
of its children's. Two trees are compared from the root down, only under nodes
that differ; rows are read only under the leaves that differ in the end. Trees
that were kept are compared without reading any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import settled
from .upkeep import row_hash

_SUMS = ("n", "d0", "d1", "d2", "d3")


def _leaf(key: str, leaves: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(leaves))


def digest_leaves(rows: DataFrame, key: str, columns: list[str], *, fan: int = 16, depth: int = 3) -> DataFrame:
    """(``node``, ``n``, ``d0`` to ``d3``): the leaves of a tree of ``fan ** depth`` of them, as a side keeps it beside its table."""
    parts = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    hashed = rows.select(_leaf(key, fan**depth).alias("node"), row_hash(columns).alias("h"))
    return hashed.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(p.cast("decimal(38,0)")).alias(f"d{k}") for k, p in enumerate(parts)])


def digest_tree(leaves: DataFrame, *, fan: int = 16, depth: int = 3) -> list[DataFrame]:
    """The tree's levels, the root first: (``node``, sums), a node's children being those whose number is it in whole ``fan``-ths."""
    levels = [leaves]
    for _ in range(depth):
        up = levels[0].withColumn("node", F.floor(F.col("node") / fan))
        levels.insert(0, up.groupBy("node").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    return levels


def differing_leaves(here: DataFrame, there: DataFrame, *, fan: int = 16, depth: int = 3) -> tuple[DataFrame, list[int]]:
    """(``node``) of the leaves that differ, and how many nodes were compared on each level."""
    open_, compared = None, []
    for a, b in zip(digest_tree(here, fan=fan, depth=depth), digest_tree(there, fan=fan, depth=depth), strict=True):
        if open_ is not None:  # children of the nodes that differ
            under = open_.withColumnRenamed("node", "parent")
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fan)).join(under, "parent", "left_semi").drop("parent") for x in (a, b))
        both = a.select("node", F.struct(*_SUMS).alias("here")).join(b.select("node", F.struct(*_SUMS).alias("there")), "node", "full_outer")
        both = settled(both.select("node", (~F.col("here").eqNullSafe(F.col("there"))).alias("differs")))
        compared.append(both.count())
        open_ = both.where("differs").select("node")
    return open_, compared


def tree_audit(local: DataFrame, remote: DataFrame, key: str, columns: list[str], *, fan: int = 16, depth: int = 3, leaves: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(``key``, ``reason``): keys whose row is ``missing`` at the other side, ``extra`` there, or a ``mismatch``.

    ``leaves``: both sides' digests, where they are kept; else they are made by a
    scan of each. Keys must be unique and not null.
    """
    here, there = leaves or tuple(settled(digest_leaves(x, key, columns, fan=fan, depth=depth)) for x in (local, remote))
    open_, _ = differing_leaves(here, there, fan=fan, depth=depth)
    under = lambda x, name: x.withColumn("node", _leaf(key, fan**depth)).join(open_, "node", "left_semi").select(key, row_hash(columns).alias(name))
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").when(F.col("here") != F.col("there"), "mismatch")
    return under(local, "here").join(under(remote, "there"), key, "full_outer").select(key, reason.alias("reason")).where("reason is not null")
