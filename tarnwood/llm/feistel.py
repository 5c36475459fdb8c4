"""Shards by a keyed permutation of global row numbers.

Rows are numbered in the order of (id, text digest, size). A balanced Feistel
network permutes the smallest even-bit domain that holds all numbers, and
cycle walking (Black and Rogaway, "Ciphers with arbitrary finite domains")
brings results outside the table back into it. The permuted number p gives the
shard, p modulo the shard count, and the slot in it, p divided by it: both are
computed, so any row's place can be found again, and the row at any place, from
the seed and the row count alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, settle

_ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Permutation:
    """A permutation of 0 .. n-1 that is fixed by ``n`` and ``seed``, and its inverse."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _keys(seed)

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & self.mask)
        return (right << self.half) | left  # halves swapped: the same network with reversed keys undoes it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1])


def shard_rows(docs: DataFrame, shards: int = 8, *, seed: int = 20240201, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``row_number``, ``shard``, ``slot``.

    Shards differ by one row at most. Null ids come first and null texts count
    as empty with size 1; rows equal in id, digest and size may swap numbers,
    which changes nothing in the result. Other columns are ignored, whatever
    their names; an empty table gives no rows.

    The text is read once, for its digest; what is sorted and written to the
    checkpoint folder is some 30 bytes a row. The range partitioning ends on a
    spread column, so one repeated id is dealt over many partitions. What
    reaches the driver is one count per partition.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = settle(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("spread"),
        )
    )
    order = ["doc_id", "text_crc32", "size", "spread"]
    ranged = settle(digests.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread"))
    # A partition's rows are numbered upward from partition << 33 in the written order.
    placed = ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33).cast("int"))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    starts = np.array(before or [0], np.int64)
    permutation = Permutation(max(total, 1), seed)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = batch.column(3).to_numpy()
        rows = starts[place >> 33] + (place & ((1 << 33) - 1))
        at = permutation.forward(rows)
        more = [pa.array(rows), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    schema = "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long"
    return placed.select("doc_id", "size", "text_crc32", "place").mapInArrow(by_batch(work), schema)
