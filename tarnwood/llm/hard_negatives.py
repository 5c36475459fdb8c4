"""Hard-negative mining by bit-sliced integer products.

Vectors are cut into bit-planes of their integer components, the sign first and
then the most significant bits. The product of an anchor and a row is taken in
plane by plane. After each plane it lies between two bounds: what is summed so
far, plus what the planes that are left could add at the least and at the most.
Rows leave as soon as their interval cannot qualify any more: as one of an
anchor's nearest, because the interval ends below the last place, or as a
negative, because it meets no band of scores that is asked for.

Anchors are a stated share of all rows, so every row meets every anchor, in
blocks: the anchors are packed into blocks of bounded size, a pass takes some of
them, at most ``pass_bytes``, to all tasks, and a task sees its own scan
partition once for the nearest and once for the negatives. No row of the table is
shuffled, only the few best of each anchor and task; no pair is ever a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, resident

#: Anchors in a block, and rows and anchors that are compared at once.
_BLOCK = 4096
_ROWS, _SIDE = 2048, 512
#: Below this share of open pairs, the rest are summed pair by pair.
_SPARSE = 1 / 16
_NONE = np.iinfo(np.int64).min


def _floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers; an error where it does not fit into 62 bits."""
    found = np.floor(scale * values.astype(np.float64))
    if len(found) and np.abs(found).max() >= 2.0**62:
        raise OverflowError("a component is too large for scores of 64 bits")
    return found.astype(np.int64)


def _vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the integer components of those, filled up with zeros to one length."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)  # null components are nan
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    good = there.copy()
    good[row[~np.isfinite(values)]] = False
    width = int(sizes[good].max()) if good.any() else 0
    out = np.zeros((len(column), width), np.int64)
    use = good[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[use], place[use]] = _floors(values[use], scale)
    return good, out[good]


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def planes(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, bits) of the planes of integer vectors, most significant first; the sign's weight is negative."""
    bits = max(1, int(np.abs(rows).max(initial=0)).bit_length())
    return [(-(1 << bits), (rows < 0).astype(np.int8)), *((1 << b, (rows >> b & 1).astype(np.int8)) for b in range(bits - 1, -1, -1))]


def open_products(anchors: np.ndarray, rows: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, product) of the pairs among ``allowed`` that stay useful to the last plane.

    ``useful(least, most, anchor)`` says for bounds of products which may still
    qualify; ``anchor`` holds the numbers of their anchors, as a column while all
    pairs are at hand and by pair afterwards.
    """
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = _widened(anchors, width), _widened(rows, width)
    size = max(1, width) * int(np.abs(anchors).max(initial=0))  # no sum over one plane is larger
    if size * 2 * (1 + int(np.abs(rows).max(initial=0))) >= 2**62:
        raise OverflowError("scores may pass 64 bits")
    kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64  # exact for every sum over a plane
    side = anchors.astype(kind)
    plus, minus = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    total = np.zeros((len(anchors), len(rows)), np.int64)
    column = np.arange(len(anchors))[:, None]
    pairs = None
    for weight, bits in planes(rows):
        left = abs(weight) - 1  # the planes after this one add so many times the anchor's parts at the most
        if pairs is None:
            total += weight * (side @ bits.T.astype(kind)).astype(np.int64)
            allowed = allowed & useful(total + (left * minus)[:, None], total + (left * plus)[:, None], column)
            if np.count_nonzero(allowed) <= _SPARSE * allowed.size:
                pairs = np.nonzero(allowed)
                total = total[pairs]
        else:
            a, r = pairs
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                total[part] += weight * np.einsum("ij,ij->i", side[a[part]], bits[r[part]].astype(kind)).astype(np.int64)
            stay = useful(total + left * minus[a], total + left * plus[a], a)
            pairs, total = (a[stay], r[stay]), total[stay]
    if pairs is None:
        pairs = np.nonzero(allowed)
        total = total[pairs]
    return *pairs, total


class Best:
    """The ``n`` best (score, id) of each of several lists: higher scores first, then smaller ids."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.full(lists, _NONE)  # the score of each full list's last place

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        first = np.searchsorted(key, key)
        place = np.arange(len(key)) - first
        keep = place < self.n
        self.key, self.score, self.id = key[keep], score[keep], ident[keep]
        full = place == self.n - 1
        self.last[key[full]] = score[full]


def _batches(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            good, rows = _vectors(part.column(2), scale)
            ids, labels = (part.column(k).to_numpy(zero_copy_only=False)[good] for k in (0, 1))
            if len(ids):
                yield ids, labels, rows


def _nearest(shared, name: str, n: int, scale: int):
    """Per task, the ``n`` best rows of the same label for each anchor of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = resident(("anchors", name), lambda: shared.value)[:3]
        best = Best(len(ids), n)
        for row_ids, row_labels, rows in _batches(batches, scale):
            for at in range(0, len(ids), _SIDE):
                part = slice(at, at + _SIDE)
                allowed = (labels[part, None] == row_labels) & (ids[part, None] != row_ids)
                last = best.last[part]
                a, r, score = open_products(anchors[part], rows, lambda low, high, k: high >= last[k], allowed)  # noqa: B023
                best.add(a + at, score, row_ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.key, best.score, best.id)], names=["anchor", "score", "vec_id"])

    return run


def _within(shared, name: str, n: int, scale: int):
    """Per task, the ``n`` best rows of another label for each band of the pass's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors, owner, low, high = resident(("bands", name), lambda: shared.value)
        best = Best(len(owner), n)
        starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        least, most = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), _NONE)
        np.minimum.at(least, owner, low)
        np.maximum.at(most, owner, high)
        asked = np.nonzero(np.diff(starts))[0]  # anchors that have a band
        for row_ids, row_labels, rows in _batches(batches, scale):
            for at in range(0, len(asked), _SIDE):
                who = asked[at : at + _SIDE]
                floor, top = least[who], most[who]
                a, r, score = open_products(anchors[who], rows, lambda x, y, k: (y >= floor[k]) & (x <= top[k]), labels[who, None] != row_labels)  # noqa: B023
                first, bands = starts[who[a]], np.diff(starts)[who[a]]
                for k in range(int(bands.max(initial=0))):  # an anchor has few bands
                    band = np.minimum(first + k, len(owner) - 1)
                    fits = (k < bands) & (score >= low[band]) & (score <= high[band]) & (score >= best.last[band])
                    best.add(band[fits], score[fits], row_ids[r[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.key, best.score, best.id)], names=["band", "score", "vec_id"])

    return run


def _anchor_blocks(scale: int):
    """Anchors packed into blocks: ``n``, ``width``, and their ids, labels and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                for ids, labels, rows in _batches(iter([batch.slice(at, _BLOCK)]), scale):
                    values = [uuid.uuid4().hex, len(ids), rows.shape[1], ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), rows.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "n", "width", "ids", "labels", "rows"])

    return run


def _first(found: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` best rows of each list over all tasks, with their ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def mine_hard_negatives(
    vectors: DataFrame, *, anchors: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pass_bytes: int = 16 << 20,
) -> DataFrame:
    """For each anchor and positive the best negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the integer product of two vectors of components floor(``scale`` *
    x). An anchor (a row for which ``anchors`` holds; by default every 50th id) has
    as positives its first ``positives`` other ids of its label, higher scores
    first and then smaller ids; a positive of score s has as negatives the first
    ``negatives`` rows of other labels with low * s <= 100 * score <= high * s.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Shorter vectors count as filled up with zeros. Rows of one id
    are rows of their own, though none is another's positive; equal anchors have
    their rows each. A vector of no component has score 0 with all. Scores past
    64 bits are an error. Other columns are ignored, whatever their names; an empty
    table, and anchors without positives or negatives, give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    chosen = F.col("vec_id") % 50 == 0 if anchors is None else anchors
    packed = Written(rows.where(chosen).mapInArrow(_anchor_blocks(scale), "block string, n long, width long, ids binary, labels binary, rows binary"))
    passes, size = [[]], 0
    for r in packed.read().select("block", (F.octet_length("rows") + 16 * F.col("n")).alias("bytes")).orderBy("block").toLocalIterator():
        if passes[-1] and size + r["bytes"] > pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append(r["block"])
        size += r["bytes"]
    found = [_one_pass(rows, packed.read().where(F.col("block").isin(p)), scale, positives, negatives, low, high) for p in passes if p]
    packed.drop()
    if not found:
        return spark.createDataFrame([], _RESULT)
    return reduce(DataFrame.unionByName, found)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _one_pass(rows: DataFrame, blocks: DataFrame, scale: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result of the anchors of some blocks, which are few enough for the driver and each worker; written."""
    sc, name = rows.sparkSession.sparkContext, uuid.uuid4().hex
    parts = blocks.orderBy("block").collect()
    width = max(r["width"] for r in parts)
    ids, labels = (np.concatenate([np.frombuffer(r[c], np.int64) for r in parts]) for c in ("ids", "labels"))
    anchors = np.concatenate([_widened(np.frombuffer(r["rows"], np.int64).reshape(r["n"], r["width"]), width) for r in parts])
    # Every sum over a plane fits; small components travel as small integers.
    anchors = anchors.astype(np.int32) if np.abs(anchors).max(initial=0) < 2**31 else anchors
    near = rows.mapInArrow(_nearest(sc.broadcast((ids, labels, anchors)), name, positives, scale), "anchor long, score long, vec_id long")
    taken = _first(near, "anchor", positives).select("anchor", "score", "vec_id", "place").toArrow()  # ``positives`` rows an anchor at most
    owner, score, positive, place = (taken.column(c).to_numpy() for c in ("anchor", "score", "vec_id", "place"))
    order = np.lexsort((place, owner))
    owner, score, positive = owner[order], score[order], positive[order]
    least, most = -(-low * score // 100), high * score // 100
    use = least <= most
    owner, score, positive, least, most = (x[use] for x in (owner, score, positive, least, most))
    if not len(owner):
        return rows.sparkSession.createDataFrame([], _RESULT)
    hard = rows.mapInArrow(_within(sc.broadcast((ids, labels, anchors, owner, least, most)), name, negatives, scale), "band long, score long, vec_id long")
    named = pa.table({"band": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score})
    bands = rows.sparkSession.createDataFrame(named)  # as many as the pass has positives
    out = _first(hard, "band", negatives).join(bands, "band")
    out = out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return Written(out).read()
