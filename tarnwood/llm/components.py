"""Connected components of links between numbered rows, by alternating stars.

Large-star and small-star steps (Kiveris, Lattanzi, Mirrokni, Rastogi and
Vassilvitskii, "Connected components in MapReduce and beyond", 2014) turn the
links into stars around each component's smallest member. Every step is an
aggregation and a join; nothing but one checksum a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node next to it.

    An edge changes only at a node that has both smaller and larger neighbours.
    A star's centre has none smaller, so its many edges meet no row here, and as
    stars form the nodes in between become few and are sent to the edges.
    """
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    between = arcs.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < u and u < x").select("u", "m")
    moved = edges.join(between, F.col("a") == F.col("u"), "left")
    return moved.select(F.coalesce("m", "a").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and itself, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b").select(F.col("m"), F.col("a").alias("v"))
    out = joined.unionByName(least.select("m", F.col("b").alias("v")))
    return out.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (``a``, ``b``): the smallest node of its component.

    Direction, repetition and self-links do not matter; a node of self-links
    only has no row. No links give no rows.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = settle(edges)
    last = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last or not now["n"]:
            break
        last = now
        edges = settle(_small_star(_large_star(edges)))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
