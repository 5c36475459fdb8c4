"""Exact removal of repeated long strings by blockwise suffix sorting over a cover sample.

Blockwise suffix sorting (Kaerkkaeinen, "Fast BWT in small space by blockwise
suffix sorting", 2007) sorts one bucket of suffixes at a time and settles long
ties by the ranks of a sample that covers every suffix within a bounded distance.
A cover by positions modulo v holds a fixed share of all suffixes (8 in 32, say),
too many rows to deal out over a cluster. The sample here is chosen by content
instead, as in string synchronizing sets (Kempa and Kociumaka, 2019): for every
window of ``length`` bytes, the position of its smallest ``gram``-byte hash.
Equal windows choose equal places, so two suffixes still meet their samples at
the same distance, and about one suffix in 39 is in the sample.

1. Samples are found in a scan of the texts; only those whose gram occurs
   elsewhere go on, with the bytes around them. Grams that repeat inside a batch
   are known to: one row in the batch's name tells the others, and the samples
   themselves are dealt out evenly, so a very common gram is no hot key.
2. A bucket is the samples of one gram. Their suffixes are sorted by the bytes
   to the right, and the reversed prefixes by those to the left; the common
   lengths of sorted neighbours give, for every distance of a window's start
   from its sample, classes of equal windows. All but the first of a class are
   repeats. Bytes are compared, never hashes. Samples with the same bytes around
   them are cut to the first one before that, batch by batch: the windows of the
   others are repeats already.
3. The repeats of a document become spans, and the spans are cut out.

A task holds the buckets it works on, a few megabytes, and never a whole text's
suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Bytes of a gram, a multiple of 8.
_GRAM = 24
_SEGMENT = 1 << 21
_POSITION = np.uint64((1 << 22) - 1)
#: No byte of UTF-8; stands for what lies beyond a text's ends.
_BEYOND = 0xFF


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``_GRAM`` bytes from each position on."""
    n = len(data) - _GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        mixed = words * _C[0]
        mixed ^= mixed >> _S32
        mixed *= _C[1]
        mixed ^= mixed >> _S29
        h = mixed[:n] * _C[0]
        for j in range(1, _GRAM // 8):
            h += mixed[8 * j : 8 * j + n] * _C[j]
            h ^= h >> _S29
        h *= _C[1]
        h ^= h >> _S32
    return h


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each ``width`` consecutive keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(keys) - width + 1], out[width - have :])
    return out


def samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple:
    """Samples of texts that lie in ``data`` from ``starts`` to ``ends``.

    Arrays: gram hash, number of the text, sample's place in ``data``, smallest
    and largest distance back to a window's start that chooses this sample.
    """
    span = length - _GRAM + 1
    h = _gram_hashes(data)
    keys = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    at = (_smallest(keys, span) & _POSITION).astype(np.int64)
    counts = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    window = np.arange(counts.sum()) - np.repeat(first - starts, counts)
    chosen = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(window))[: len(lo)] - 1
    a = chosen[lo]
    return h[a].view(np.int64), owner[lo], a, a - window[hi], a - window[lo]


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of about a segment: bytes, row numbers, starts, ends, and each one's offset in its text."""
    texts, rows, size = [], [], 0
    for i in range(len(column)):
        value = column[i].as_buffer() if column[i].is_valid else None
        n = value.size if value else 0
        if n < length:
            continue
        for at in range(0, n - length + 1, _SEGMENT):
            part = memoryview(value)[at : at + _SEGMENT + length - 1]
            if size and size + len(part) > _SEGMENT + length:
                yield _joined(texts, rows)
                texts, rows, size = [], [], 0
            texts.append(part)
            rows.append((i, at))
            size += len(part)
    if rows:
        yield _joined(texts, rows)


def _joined(texts: list, rows: list) -> tuple:
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), [r for r, _ in rows], ends - sizes, ends, np.array([o for _, o in rows])


#: A sample as one number: its place, whether its gram is known to repeat, and the distances back to its windows' starts.
_KNOWN = 1 << 20


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly."""
    with np.errstate(over="ignore"):
        x = (a.view(np.uint64) * _C[0] + b.view(np.uint64)) * _C[1]
        return (x ^ (x >> _S29)).view(np.int64)


def _sampler(length: int):
    names = ["deal", "row", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            grams, owners, numbers = [], [], []
            for data, rows, starts, ends, offset in _segments(batch.column(2), length):
                gram, owner, a, near, far = samples(data, starts, ends, length)
                grams.append(gram)
                owners.append(ids[np.array(rows)[owner]])
                numbers.append(((a - starts[owner] + offset[owner]) << 21) | (near << 10) | far)
            if not grams:
                continue
            gram, row, packed = map(np.concatenate, (grams, owners, numbers))
            order = np.argsort(gram, kind="stable")
            same = gram[order[1:]] == gram[order[:-1]]
            many = np.zeros(len(gram), bool)
            many[order[1:]] |= same
            many[order[:-1]] |= same
            marks = np.unique(gram[many])
            deal = np.where(many, _spread(row, packed), gram)
            packed = np.where(many, packed | _KNOWN, packed)
            columns = [np.append(deal, marks), np.append(row, np.zeros(len(marks), np.int64)), np.append(packed, np.full(len(marks), -1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _context_maker(length: int):
    """The samples' surroundings, those of equal bytes once a batch, and the spans of the others."""
    left, right = length - _GRAM, length
    width = left + right
    schema = pa.schema(
        [("gram", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("packed", pa.int64()), ("stop", pa.int64()), ("context", pa.binary())]
    )

    def around(data: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """What the windows of each sample reach; the rest is blanked out and compresses to nothing."""
        reach = np.arange(-left, right)
        near, far = ((packed >> 10) & 1023)[:, None], (packed & 1023)[:, None]
        index = (packed >> 21)[:, None] + reach
        return np.where((reach >= -far) & (reach < length - near), data[np.clip(index, 0, len(data) - 1)], np.uint8(_BEYOND))

    def made(doc: np.ndarray, known: np.ndarray, row: np.ndarray, packed: np.ndarray, contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort([packed, row, doc, known])
        raw, seen = contexts.tobytes(), set()
        first = np.zeros(len(order), bool)
        for i in order.tolist():
            one = raw[i * width : (i + 1) * width]
            if one not in seen:
                seen.add(one)
                first[i] = True
        keep, drop = np.flatnonzero(first), order[~first[order]]
        grams = _gram_hashes(np.ascontiguousarray(contexts[keep, left : left + _GRAM]).reshape(-1))[::_GRAM] if len(keep) else np.empty(0, np.uint64)
        flat = np.ascontiguousarray(contexts[keep])
        bounds = pa.py_buffer(np.arange(0, (len(keep) + 1) * width, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(grams.view(np.int64)), pa.array(doc[keep], mask=~known[keep]), pa.array(row[keep]), pa.array(packed[keep]),
                pa.nulls(len(keep), pa.int64()), pa.Array.from_buffers(pa.binary(), len(keep), [None, bounds, pa.py_buffer(flat)]),
            ],
            schema=schema,
        )
        if len(drop):
            by = np.lexsort([packed[drop], row[drop]])
            r, q = row[drop][by], packed[drop][by]
            start, stop = (q >> 21) - (q & 1023), (q >> 21) - ((q >> 10) & 1023) + length
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (start[1:] > stop[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(r)) - 1
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(r[at], start[at])), none, pa.array(r[at]), pa.array(start[at]), pa.array(stop[last]), pa.nulls(len(at), pa.binary())], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1)
            known = np.asarray(docs.is_valid())
            docs = docs.fill_null(0).to_numpy()
            texts, found = batch.column(2), batch.column(3)
            held: list[tuple] = []
            n = 0
            for i in range(len(rows)):
                data, packed = np.frombuffer(texts[i].as_buffer(), np.uint8), found[i].values.to_numpy()
                for k in range(0, len(packed), most):
                    part = packed[k : k + most]
                    held.append((np.full(len(part), docs[i]), np.full(len(part), known[i]), np.full(len(part), rows[i]), part, around(data, part)))
                    n += len(part)
                    if n >= most:
                        yield from made(*map(np.concatenate, zip(*held, strict=True)))
                        held, n = [], 0
            if held:
                yield from made(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _sorted_classes(gram: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (gram, bytes), and for each place the length in common with the one before; -1 at a new gram."""
    m, width = strings.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*words.T[::-1], gram])
    s = strings[order]
    common = np.full(m, -1, np.int64)
    if m > 1:
        differs = s[1:] != s[:-1]
        common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        g = gram[order]
        common[1:][g[1:] != g[:-1]] = -1
    return order, common


def repeats(gram: np.ndarray, near: np.ndarray, far: np.ndarray, contexts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For samples in the order of their texts: the smallest and largest distance of a repeated window; -1 without one.

    ``contexts`` has ``length - _GRAM`` bytes left and ``length`` bytes right of each sample.
    """
    left = length - _GRAM
    m = len(gram)
    by_right, right_common = _sorted_classes(gram, contexts[:, left:])
    by_left, left_common = _sorted_classes(gram, contexts[:, left - 1 :: -1] if left else contexts[:, :0])
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    right, leftward = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(left + 1):
        active = np.flatnonzero((near <= o) & (o <= far))
        if len(active) < 2:
            continue
        right[by_right] = np.cumsum(right_common < length - o)
        leftward[by_left] = np.cumsum(left_common < o)
        name = right[active] * (m + 1) + leftward[active]
        order = np.argsort(name, kind="stable")
        again = np.zeros(len(active), bool)
        again[order[1:]] = name[order[1:]] == name[order[:-1]]
        hit = active[again]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high


def _bucket_sorter(length: int, block: int = 40_000):
    width = 2 * length - _GRAM

    def worked(table: pa.Table) -> pa.RecordBatch:
        ready = table.filter(pc.is_null(table["context"])).select(["row", "packed", "stop"]).combine_chunks()
        columns = table.filter(pc.is_valid(table["context"])).combine_chunks()
        doc = columns["doc_id"]
        known = np.asarray(doc.is_valid())
        docs = doc.fill_null(0).to_numpy()
        row, packed, gram = (columns[c].to_numpy() for c in ("row", "packed", "gram"))
        order = np.lexsort([packed, row, docs, known])
        raw = b"".join(columns["context"].to_pylist())
        contexts = np.frombuffer(raw, np.uint8).reshape(-1, width)[order]
        row, packed, gram = row[order], packed[order], gram[order]
        low, high = repeats(gram, (packed >> 10) & 1023, packed & 1023, contexts, length)
        hit = np.flatnonzero(low >= 0)
        place = packed[hit] >> 21
        spans = ((row[hit], "row"), (place - high[hit], "packed"), (place - low[hit] + length, "stop"))
        return pa.RecordBatch.from_arrays([pa.array(np.append(a, ready[c].to_numpy())) for a, c in spans], names=["row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; a bucket is never split."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= block:
                last = held[-1].column(0)[len(held[-1]) - 1].as_py()
                gram = batch.column(0).to_numpy()
                cut = 0
                if gram[-1] == last and gram[0] == last:
                    cut = len(gram)
                elif gram[0] == last:
                    cut = int(np.argmax(gram != last))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(gram):
                    yield worked(pa.Table.from_batches(held))
                    held, n = [batch.slice(cut)], len(gram) - cut
                else:
                    n += cut
            else:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield worked(pa.Table.from_batches(held))

    return run


def _remover():
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, texts, found = (batch.column(i) for i in (1, 2, 3))
            sizes, removed, spans, kept = [], [], [], []
            for i in range(len(doc)):
                text = texts[i].as_py() or b""
                pieces, at, gone, count = [], 0, 0, 0
                stop = -1
                for r in sorted((x["start"], x["stop"]) for x in found[i].as_py() or ()):
                    if r[0] > stop:
                        pieces.append(text[at : r[0]])
                        count += 1
                        gone += r[1] - r[0]
                        at = stop = r[1]
                    elif r[1] > stop:
                        gone += r[1] - stop
                        at = stop = r[1]
                pieces.append(text[at:])
                sizes.append(len(text))
                removed.append(gone)
                spans.append(count)
                kept.append(b"".join(pieces))
            columns = [doc, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_text`` (binary).

    Removed is every byte covered by a ``length``-byte string (64 to 1000) that
    also starts earlier, in a row of a smaller id, or earlier in the same row.
    Null ids come first; rows of one id are ordered as they are read. A null
    text is empty; other columns are ignored, whatever their names; an empty
    table gives no rows. ``kept_text`` may end inside a character.
    """
    if not 64 <= length <= 1000:
        raise ValueError("length must be from 64 to 1000")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text).repartition("row")
    found = rows.mapInArrow(_sampler(length), "deal long, row long, packed long")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("deal")))
    again = (F.col("n") > 1) | (F.col("packed").bitwiseAND(F.lit(_KNOWN)) != 0)
    # The bound is on a column that no join sees: one on "row" would be pushed below the exchange of the texts, which is used thrice.
    listed = counted.where(again & (F.col("packed") >= 0)).groupBy("row").agg(F.collect_list("packed").alias("found"))
    contexts = rows.join(listed, "row").select("row", "doc_id", "text", "found").mapInArrow(
        _context_maker(length), "gram long, doc_id long, row long, packed long, stop long, context binary"
    )
    spans = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_bucket_sorter(length), "row long, start long, stop long")
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = rows.join(by_row, "row", "left").select("row", "doc_id", "text", "spans")
    return cut.mapInArrow(_remover(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary")
