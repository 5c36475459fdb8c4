"""Near-duplicate groups by circulant MinHash, banding and exact verification.

1. Every document gets its shingle set's size, a 128-bit digest of the set and
   the band keys of its signature. Documents of equal sets form one class, so
   exact copies cost one row each from here on, whatever their number.
2. Classes that share a band key are candidates. A bucket is never expanded into
   its pairs: its members are first compared with its smallest member only, and
   links become components by alternating stars.
3. Classes joined by buckets form families. Where a family still has two
   components or more, candidates in different ones are left to compare. The
   family is dealt into blocks of some ``_BLOCK`` classes, neighbours together:
   by component where one is large, else by the smallest member met in a bucket.
   Two blocks are compared only if a bucket holds classes of different
   components from both, which is found out from numbers alone, before any set
   is moved. They make one row: all intersections between them are one matrix
   product over the shingles that both hold. No row is made for a pair of classes.

Every comparison is exact, on the full sets.

With 32 bands of 4 coordinates, a pair at similarity 0.8 shares no band with a
probability of 5e-8. Sets of under t / (1 - t) shingles can only be linked to
equal ones, which the classes already do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, resident, settle
from .components import components
from .shingles import CirculantMinHash, WordHashes, set_digest, shingle_set

_BLOCK = 256


def _signer(width: int, minhash: CirculantMinHash, least: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = resident(("hashes",), WordHashes)
        texts, sizes, digests, keys = batch.column(1), [], [], []
        for i in range(len(texts)):
            s = shingle_set(texts[i].as_py(), width, hashes)
            sizes.append(len(s))
            digests.append(set_digest(s) if len(s) else None)
            keys.append(minhash.band_keys(minhash.signature(s)) if len(s) >= least else None)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    return by_batch(work)


def _set_maker(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hashes = batch.column(2), resident(("hashes",), WordHashes)
        sets = [shingle_set(texts[i].as_py(), width, hashes) for i in range(len(texts))]
        same = [set_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
        columns = [batch.column(0), pa.array(same, pa.bool_()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["rep", "same", "shingles"])

    return by_batch(work)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    close = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a bucket's smallest member and each other one, within the length bound."""
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    return members.where((F.col("rep") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def _block_comparer(percent: int):
    """Links between two blocks: of different components, sharing a band key, similar on the full sets."""

    def sides(block: dict) -> tuple:
        rep, n, label = (np.array(block[c], np.int64) for c in ("rep", "n", "label"))
        bands = np.array(block["bands"], np.int64)
        sets = [np.array(x, np.int64) for x in block["shingles"]]
        return rep, n, label, bands, sets

    def counts(left: list, right: list) -> np.ndarray:
        """Sizes of all intersections."""
        shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
        total = np.zeros((len(left), len(right)), np.float64)
        for at in range(0, len(shared), 1 << 14):
            part = shared[at : at + (1 << 14)]
            both = []
            for sets in (left, right):
                dense = np.zeros((len(sets), len(part)), np.float32)
                for i, s in enumerate(sets):
                    place = np.searchsorted(part, s)
                    place[place == len(part)] = 0
                    dense[i, place[part[place] == s]] = 1
                both.append(dense)
            total += both[0] @ both[1].T
        return total.astype(np.int64)

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ra, na, la, ba, sa), (rb, nb, lb, bb, sb) = (sides(batch.column(j)[k].as_py()) for j in (0, 1))
                may = (la[:, None] != lb[None]) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
                touch = np.zeros_like(may)
                for j in range(ba.shape[1]):
                    touch |= ba[:, j, None] == bb[None, :, j]
                may &= touch
                if not may.any():
                    continue
                i, j = may.any(axis=1), may.any(axis=0)
                inter = np.zeros(may.shape, np.int64)
                inter[np.ix_(i, j)] = counts([s for s, u in zip(sa, i, strict=True) if u], [s for s, u in zip(sb, j, strict=True) if u])
                x, y = np.nonzero(may & (100 * inter >= percent * (na[:, None] + nb - inter)))
                yield pa.RecordBatch.from_arrays([pa.array(ra[x]), pa.array(rb[y])], names=["a", "b"])

    return work


def _across(keyed: DataFrame, members: DataFrame, classes: DataFrame, sets: DataFrame, families: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one family.

    ``keyed`` has a row (``rep``, ``key``) for each class and bucket, ``members``
    (``rep``, ``pivot``) the smallest members of a class's buckets.
    """
    named = families.select(F.col("node").alias("rep"), F.col("label").alias("family"))
    named = named.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    split = named.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("family")
    near = members.groupBy("rep").agg(F.min("pivot").alias("near"))
    apart = settle(named.join(split, "family").join(near, "rep"))
    # A component of a block or more has blocks of its own; the others share some.
    sizes = apart.groupBy("family", "label").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("own", F.when(F.col("size") >= _BLOCK, F.col("label")))
    parts = sizes.groupBy("family", "own").agg(F.ceil(F.sum("size") / _BLOCK).cast("int").alias("blocks"))
    placed = apart.join(sizes.select("family", "label", "own"), ["family", "label"])
    placed = placed.join(parts, (placed["family"] == parts["family"]) & placed["own"].eqNullSafe(parts["own"])).drop(parts["family"]).drop(parts["own"])
    # Classes with one smallest member lie together, as many as fit into a block.
    crowd = placed.groupBy("family", "own", "near").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("cells"))
    crowd = crowd.select(F.col("family").alias("f"), F.col("own").alias("o"), F.col("near").alias("m"), "cells")
    on = (F.col("family") == F.col("f")) & F.col("own").eqNullSafe(F.col("o")) & (F.col("near") == F.col("m"))
    cell = F.pmod(F.xxhash64("rep"), F.col("cells"))
    block = F.pmod(F.xxhash64("near", cell), F.col("blocks")).cast("int")
    placed = settle(placed.join(crowd, on).select("family", F.col("own"), "label", "rep", block.alias("block")))

    met = keyed.join(placed, "rep").groupBy("key", "family", "own", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = met.groupBy("key", "family").agg(F.sort_array(F.collect_list(F.struct("own", "block", "lo", "hi"))).alias("x"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    held = held.where("lo < hi").select("family", F.posexplode("x").alias("i", "a"), F.col("x"))
    held = held.select("family", "a", F.explode(F.slice("x", F.col("i") + 1, F.size("x"))).alias("b"))
    differ = ~((F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")))
    pairs = held.where(differ).select("family", *[F.col(f"{side}.{c}").alias(f"{c}_{x}") for side, x in (("a", "x"), ("b", "y")) for c in ("own", "block")]).distinct()

    whole = placed.join(sets, "rep").join(classes.select("rep", "n", "bands"), "rep")
    packed = settle(
        whole.groupBy("family", "own", "block").agg(
            F.struct(*[F.collect_list(c).alias(c) for c in ("rep", "n", "label", "bands", "shingles")]).alias("rows")
        )
    )
    for x in "xy":
        one = packed.select(F.col("family").alias("f"), F.col("own").alias("o"), F.col("block").alias("b"), F.col("rows").alias(f"rows_{x}"))
        on = (F.col("family") == F.col("f")) & F.col(f"own_{x}").eqNullSafe(F.col("o")) & (F.col(f"block_{x}") == F.col("b"))
        pairs = pairs.join(one, on).drop("f", "o", "b")
    return pairs.select("rows_x", "rows_y").mapInArrow(_block_comparer(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Linked are documents whose sets of distinct ``width``-word shingles have
    ``percent`` or more of their union in common. A text of fewer words is one
    shingle; null, empty and wordless texts have none, are linked with nothing
    and are kept. ``component_id`` is the smallest id reachable. Rows without an
    id cannot be named and are linked with nothing: null component, kept.
    Repeated ids are nodes of one name; equal texts are linked. Other columns
    are ignored, whatever their names; an empty table gives no rows. Texts of any
    length are taken whole: a set is 8 bytes a shingle, in a task of its own row.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = math.ceil(percent / max(100 - percent, 1))
    signed = settle(
        base.mapInArrow(_signer(width, CirculantMinHash(bands, rows), least), "doc_id long, n_shingles long, digest binary, bands array<long>")
    )
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(named.groupBy("digest").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands")).alias("c")).select("digest", "c.*"))
    classes = classes.withColumnRenamed("doc_id", "rep")

    keyed = classes.where("bands is not null").select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max("rep").alias("hi")).where("lo.rep < hi")
    first = shared.select("key", F.col("lo.rep").alias("pivot"), F.col("lo.n").alias("pivot_n"))
    members = settle(keyed.join(first, "key").select("rep", "n", "pivot", "pivot_n").distinct())

    wanted = classes.select("rep", "digest").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = base.join(wanted, base["doc_id"] == wanted["rep"]).select("rep", "digest", "text")
    made = texts.mapInArrow(_set_maker(width), "rep long, same boolean, shingles array<long>").where("same")
    sets = settle(made.dropDuplicates(["rep", "shingles"]).select("rep", "shingles"))

    links = settle(_verified(_pairs(members, percent), sets, percent))
    labels = components(links)
    families = components(members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    more = settle(_across(keyed.select("rep", "key"), members, classes.where("bands is not null"), sets, families, labels, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    of_class = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
