"""Comparison of vectors with each other by blocks, without the pairs of blocks that cannot reach the threshold.

Angles between vectors are a metric. Vectors are dealt by the nearest of some
pivots, and within it by rings of equal angle to it, into blocks of about
``size``. A block knows its least and largest angle to every pivot; if for any
pivot the ranges of two blocks lie further apart than the threshold's angle, no
pair of them can be near enough, and the two are never brought together.

Neighbouring blocks form groups of some megabytes, and two groups meet as one
cell that compares those of their blocks that are near enough: a vector is sent
once for each group, not once for each block. Similarities are matrix products in
single precision; what they leave over the threshold, less their error, is
computed anew in double. No row is made for a pair that fails the threshold, and
of a vector's neighbours a cell gives out the best only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pivots, and rows among which they are chosen, at the most.
_PIVOTS, _SAMPLE = 64, 2048
#: Angles may be off by so much.
_SLACK = 1e-6
#: Bytes of a group's vectors; groups that a table of some size has at the least; candidates that are looked at together, and kept before they are cut.
_GROUP, _GROUPS, _CHUNK, _HELD = 8 << 20, 24, 1 << 16, 1 << 20
#: Rows and columns of the products that are made at once; tasks that the cells are dealt over at the most.
_ROWS, _COLUMNS, _TASKS = 128, 4096, 256


def _units(m: np.ndarray) -> np.ndarray:
    """Unit vectors as rows; a vector without length stays zero."""
    norms = np.linalg.norm(m, axis=1)
    return m / np.where(norms > 0, norms, np.inf)[:, None]


def _matrix(values: list) -> np.ndarray:
    return _units(np.array(values, np.float64).reshape(len(values), -1))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def chosen_pivots(units: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other: each the one farthest from those before it."""
    picked = [0]
    far = _angles(units, units[:1])[:, 0]
    while len(picked) < min(n, len(units)):
        k = int(np.argmax(far))
        if far[k] <= _SLACK:
            break
        picked.append(k)
        far = np.minimum(far, _angles(units, units[k : k + 1])[:, 0])
    return units[picked]


def _stored(vectors: DataFrame, vector_col: str):
    """The type of the numbers that vectors are sent as."""
    return np.float32 if vectors.schema[vector_col].dataType.elementType == T.FloatType() else np.float64


def _placed(clean: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(``id``, ``v``, ``part``, ``own``, ``angles``): each vector, as the bytes of its numbers, with its nearest pivot and its angles to all."""
    shared = clean.sparkSession.sparkContext.broadcast(pivots)
    dtype = _stored(clean, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                angles = _angles(_units(raw.astype(np.float64)), shared.value)
                part = np.argmin(angles, axis=1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
                data = pa.array([row.tobytes() for row in raw.astype(dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), data, pa.array(part.astype(np.int32)), pa.array(angles[np.arange(len(part)), part]), listed], names=["id", "v", "part", "own", "angles"])

    return clean.mapInArrow(run, "id long, v binary, part int, own double, angles array<double>")


def _dealt(placed: DataFrame, size: int) -> DataFrame:
    """The vectors with their block: by pivot, by ring, and by id where a ring holds more than ``size``."""
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("own").alias("least"), F.max("own").alias("most"))
    rings = F.ceil(F.col("n") / size)
    width = F.greatest((F.col("most") - F.col("least")) / rings, F.lit(1e-12))
    ringed = placed.join(F.broadcast(parts), "part")  # a row for each pivot
    ringed = ringed.withColumn("ring", F.least(F.floor((F.col("own") - F.col("least")) / width), rings - 1).cast("int")).drop("n", "least", "most")
    full = ringed.groupBy("part", "ring").agg(F.ceil(F.count("*") / size).cast("int").alias("splits"))
    split = F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")
    return ringed.join(full, ["part", "ring"]).withColumn("split", split).select("id", "v", "part", "ring", "split", "angles")


def _gap(a, b) -> float:
    """How far the ranges of two lie apart, by the pivot that tells most."""
    return max(max(p - q, r - s) for p, q, r, s in zip(a["least"], b["most"], b["least"], a["most"], strict=True))


def _blocks(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The blocks with their number and group, the pairs of blocks that are to be compared, the vectors with block and group, and how many groups there are."""
    kind = "array<float>" if _stored(vectors, vector_col) is np.float32 else "array<double>"
    clean = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    if threshold >= 0:  # a vector without length has no angle, and is like nothing
        clean = clean.where(F.exists("v", lambda x: x != 0))
    count = clean.count()
    n = min(_PIVOTS, max(1, math.isqrt(-(-count // size)) * 4))
    some = clean.orderBy(F.xxhash64("id"), "id").limit(_SAMPLE).collect()  # a bounded sample, which decides where blocks lie and no result
    pivots = chosen_pivots(_matrix([r["v"] for r in some]), n) if some else np.zeros((1, 1))
    dealt = _dealt(_placed(clean, pivots), size)
    bound = lambda agg, k: agg(F.col("angles")[k])
    each = range(len(pivots))
    block = ["part", "ring", "split"]
    ranges = dealt.groupBy(*block).agg(
        F.count("*").alias("n"), F.array(*[bound(F.min, k) for k in each]).alias("least"), F.array(*[bound(F.max, k) for k in each]).alias("most"),
    )
    reach = math.acos(max(-1.0, min(1.0, threshold))) + _SLACK
    outer = [F.array(*[f(F.col(c)[k]) for k in each]).alias(c) for c, f in (("least", F.min), ("most", F.max))]
    held = ranges.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), *outer).orderBy("part").collect()  # a row for each pivot
    near = [(a["part"], b["part"]) for a in held for b in held if a["part"] <= b["part"] and (threshold < 0 or _gap(a, b) <= reach)]
    starts = [(h["part"], sum(x["n"] for x in held[:i]), sum(x["blocks"] for x in held[:i])) for i, h in enumerate(held)]
    width = max(size, min(_GROUP // (8 * pivots.shape[1]), max(4 * size, -(-count // _GROUPS))))
    along = Window.partitionBy("part").orderBy("ring", "split")
    placed = ranges.join(F.broadcast(dealt.sparkSession.createDataFrame(starts, "part int, row long, first long")), "part")
    number = (F.col("first") + F.row_number().over(along) - 1).cast("int")
    group = F.floor((F.col("row") + F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / width).cast("int")
    packed = placed.select(*block, F.format_string("%d-%d-%d", *block).alias("block"), number.alias("k"), group.alias("g"), "least", "most")
    x, y = (packed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("part", "block", "k", "g", "least", "most")]) for s in "xy")
    parts = dealt.sparkSession.createDataFrame(near, "part_x int, part_y int")
    pairs = x.join(F.broadcast(parts), "part_x").join(y, "part_y").where("k_x <= k_y")
    if threshold >= 0:
        gaps = [F.greatest(F.col("least_x")[k] - F.col("most_y")[k], F.col("least_y")[k] - F.col("most_x")[k]) for k in each]
        pairs = pairs.where(F.array_max(F.array(*gaps)) <= reach)
    pairs = pairs.select(F.col("block_x").alias("bx"), F.col("block_y").alias("by"), "k_x", "k_y", F.col("g_x").alias("gx"), F.col("g_y").alias("gy"))
    rows = dealt.drop("angles").join(packed.select(*block, "k", "g"), block).select("id", "v", "k", "g")
    return packed, pairs, rows, -(-count // width)


def block_pairs(vectors: DataFrame, threshold: float, *, id_col: str = "id", vector_col: str = "embedding", size: int = 512) -> DataFrame:
    """(``bx``, ``by``): the pairs of blocks that ``similar_pairs`` compares."""
    return _blocks(vectors, threshold, id_col, vector_col, size)[1].select("bx", "by")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, which follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and last != tuple(values[low]):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(values[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


class _Side:
    """The vectors of one or two groups in the order of their blocks: ids, blocks, unit vectors in both precisions, and where each block stands."""

    def __init__(self, rows: pa.Table, dtype):
        self.ids, self.k = (rows.column(c).to_numpy() for c in ("id", "k"))
        self.units = _units(np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype).reshape(len(self.ids), -1).astype(np.float64))
        self.single = self.units.astype(np.float32)
        known, first = np.unique(self.k, return_index=True)
        self.at = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(self.ids)], strict=True), strict=True))
        #: What a product in single precision, and rounding to nine places, can be off.
        self.error = (self.units.shape[1] + 8) * 2.0**-23 + 1e-8

    def scored(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.floor(np.einsum("ij,ij->i", self.units[x], self.units[y]) * 1e9 + 0.5) / 1e9


class _Best:
    """Candidates (place, place, score), cut to the ``limit`` best of each first place now and then; ties by the second's id."""

    def __init__(self, ids: np.ndarray, limit: int):
        self.ids, self.limit, self.held, self.size = ids, limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        self.held.append((a, b, score))
        self.size += len(a)
        if self.size > _HELD:
            self.cut()

    def cut(self) -> None:
        a, b, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((self.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        fresh = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
        keep = np.arange(len(a)) - start < self.limit
        self.held, self.size = [(a[keep], b[keep], score[keep])], int(keep.sum())


def _cells(pairs: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """(``gx``, ``gy``, ``k``, ``todo``, ...): for each two groups that meet the pairs of blocks to compare, as a first row without a block, then the rows of both."""
    cells = pairs.groupBy("gx", "gy").agg(F.sort_array(F.collect_list(F.struct("k_x", "k_y"))).alias("todo"))
    ends = cells.select("gx", "gy", F.explode(F.array_distinct(F.array("gx", "gy"))).alias("g"))
    sent = rows.join(F.broadcast(ends), "g").select("gx", "gy", "k", *[c for c in rows.columns if c not in ("k", "g")])  # a row for two groups
    both = sent.unionByName(cells, allowMissingColumns=True)
    return both.repartition(max(1, min(_TASKS, groups * (groups + 1) // 2)), "gx", "gy").sortWithinPartitions("gx", "gy", F.asc_nulls_first("k"))


def _met(todo: list[dict], side: _Side) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece, the blocks of a cell: a block's number, places of its rows, of rows that they are to be compared with, and the products in single precision.

    Pieces stay in a processor's cache; each stands in the place of the last.
    """
    wanted: dict[int, list[int]] = {}
    for pair in todo:
        wanted.setdefault(pair["k_x"], []).append(pair["k_y"])
    space = np.empty(_ROWS * _COLUMNS, np.float32)
    for k, others in wanted.items():
        all_y = np.concatenate([np.arange(*side.at[o]) for o in others])
        low, high = side.at[k]
        for y in (all_y[c : c + _COLUMNS] for c in range(0, len(all_y), _COLUMNS)):
            turned = np.ascontiguousarray(side.single[y].T)
            for r in range(low, high, _ROWS):
                x = np.arange(r, min(r + _ROWS, high))
                yield k, x, y, np.matmul(side.single[r : r + len(x)], turned, out=space[: len(x) * len(y)].reshape(len(x), len(y)))


def _chunks(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the pairs that a mask names, some at a time."""
    found = np.flatnonzero(mask)
    for low in range(0, len(found), _CHUNK):
        i, j = np.divmod(found[low : low + _CHUNK], len(y))
        yield x[i], y[j]


def _given(side: _Side, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(side.ids[x]), pa.array(side.ids[y]), pa.array(score)], names=["a", "b", "score"])


def similar_pairs(vectors: DataFrame, threshold: float, *, id_col: str = "id", vector_col: str = "embedding", size: int = 512, keep_all: bool = False) -> DataFrame:
    """(``a``, ``b``, ``score``) for pairs of cosine over ``threshold``, rounded to nine places.

    By default ``a < b``; with ``keep_all`` both orders and each vector with
    itself. Null vectors are left out. The vectors must have one dimension.
    """
    _, pairs, rows, groups = _blocks(vectors, threshold, id_col, vector_col, size)
    dtype = _stored(vectors, vector_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, 2):
            todo, side = cell.column("todo")[0].as_py(), _Side(cell.slice(1), dtype)
            least = threshold - side.error
            for k, xs, ys, products in _met(todo, side):
                for x, y in _chunks(products > least, xs, ys):
                    score = side.scored(x, y)
                    over = score > threshold
                    same = side.k[y] == k
                    if not keep_all:
                        over &= ~same | (side.ids[x] < side.ids[y])
                        swap = side.ids[x] > side.ids[y]
                        x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield _given(side, x[over], y[over], score[over])
                    if keep_all:
                        over &= ~same
                        yield _given(side, y[over], x[over], score[over])

    return _cells(pairs, rows, groups).mapInArrow(compare, "a long, b long, score double")


def nearest_pairs(vectors: DataFrame, threshold: float, limit: int, *, id_col: str = "id", vector_col: str = "embedding", size: int = 512) -> DataFrame:
    """The rows of ``similar_pairs`` with ``keep_all`` that can be among the ``limit`` best of their ``a``, ties by ``b``; each cell gives out at most so many.

    What a vector finds in its own group bounds what it must find elsewhere.
    """
    _, pairs, rows, groups = _blocks(vectors, threshold, id_col, vector_col, size)
    dtype = _stored(vectors, vector_col)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            side = _Side(group, dtype)
            n = len(side.ids)
            bound = np.full(n, threshold - side.error)
            for low in range(0, n if n >= limit else 0, size):
                products = np.nan_to_num(side.single[low : low + size] @ side.single.T, nan=-2.0)
                last = np.partition(products, n - limit, axis=1)[:, n - limit]
                bound[low : low + size] = np.maximum(bound[low : low + size], last - 2 * side.error)
            table = group.append_column("bound", pa.array(bound))
            yield from table.combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, 2):
            todo, side = cell.column("todo")[0].as_py(), _Side(cell.slice(1), dtype)
            bound = cell.slice(1).column("bound").to_numpy().astype(np.float32) - np.float32(side.error)
            best = _Best(side.ids, limit)
            for k, xs, ys, products in _met(todo, side):
                for mask, turned in ((products > bound[xs][:, None], False), (products > np.where(side.k[ys] == k, np.float32(np.inf), bound[ys]), True)):
                    for x, y in _chunks(mask, xs, ys):
                        score = side.scored(x, y)
                        over = score > threshold
                        a, b = (y, x) if turned else (x, y)
                        best.add(a[over], b[over], score[over])
            if best.size:
                best.cut()
                yield _given(side, *best.held[0])

    held = rows.select("g", "k", "id", "v").repartition(max(1, min(_TASKS, groups)), "g").sortWithinPartitions("g", "k").mapInArrow(bounded, "g int, k int, id long, v binary, bound double")
    return _cells(pairs, held, groups).mapInArrow(compare, "a long, b long, score double")
