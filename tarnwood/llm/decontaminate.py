"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item becomes windows of ``width`` consecutive words (an item of
fewer words is one window). A document can contain a window only if it holds all
its words, so a prefix of one word is enough, and the words are ordered by
rarity over all documents: only the rarest word of each window is joined. A
match fixes where the window would lie; positional and length bounds drop it
unless that place is inside the document, and the words are compared one by one.

Windows, their items and their rarest words are rows made and joined in Spark. If
they come to ``broadcast_bytes`` or less, which is measured first, every task
holds them as an index and the documents are neither shuffled nor joined. Beyond
that they stay where they are: a bit field of fixed size tells which words of a
document are some window's rarest, those places go out with the words around
them and meet the windows in a shuffled join on the word. Both ways give the same
rows. Documents are scanned once more before, to count the benchmark's words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, carried, ddl, lower_ascii, resident

#: Words of this contract: ASCII digits and letters, and everything beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of the benchmark's words that are broadcast, alone and with their counts; beyond, counts come by shuffled joins.
_VOCABULARY = 4 << 20
#: Words that a task counts before it sends them on.
_HELD = 200_000
#: Bits of the field that tells rarest words from others, and of a piece of it.
_FIELD, _PIECE = 1 << 26, 1 << 16


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    return _WORD.findall(lower_ascii(text)) if text else []


def windows_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    """The windows of an item; none if it has no word."""
    if not words:
        return set()
    if len(words) <= width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {w for t in batch.column(0).to_pylist() for w in words_of(t)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])


def _window_rows(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = windows_of(words_of(text), width)
                items += [item] * len(found)
                windows += map(list, found)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.list_(pa.string()))], names=["item", "words"])

    return work


def _counts(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(``word``, ``n``): how often each of ``words`` stands in the texts; those that do not are left out."""
    known, size = None, words.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0]
    if size <= _VOCABULARY:
        known = rows.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in words.toLocalIterator()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            texts = batch.column(0)
            for i in range(len(texts)):
                found = words_of(texts[i].as_py())
                counts.update(filter(known.value.__contains__, found) if known else found)
                if len(counts) > _HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    counted = rows.select("text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return F.broadcast(counted) if known else counted.join(words, "word", "left_semi")


def _rarest(windows: DataFrame, counted: DataFrame) -> DataFrame:
    """(``word``, ``at``, ``words``, ``items``): each window with its rarest word and that word's place; none that holds a word of no document."""
    spread = windows.select("words", "items", F.posexplode("words").alias("at", "word")).join(counted, "word", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r")
    return spread.groupBy("words", "items").agg(least).where("r.n > 0").select("r.word", "r.at", "words", "items")


def _index(table: pa.Table) -> dict[str, dict[tuple[int, int], dict[tuple, list[str]]]]:
    """Rarest word -> (its place in the window, the window's length) -> window -> items."""
    index: dict = {}
    for word, at, words, items in zip(*(table.column(c).to_pylist() for c in ("word", "at", "words", "items")), strict=True):
        index.setdefault(word, {}).setdefault((at, len(words)), {})[tuple(words)] = items
    return index


def _probe(words: list[str], index: dict, hits: bytearray, items: set[str]) -> None:
    """Mark the words of a document that lie in an occurrence of a window."""
    n = len(words)
    for p in [i for i, w in enumerate(words) if w in index]:
        for (at, length), windows in index[words[p]].items():
            start = p - at
            if start < 0 or start + length > n:
                continue
            who = windows.get(tuple(words[start : start + length]))
            if who:
                hits[start : start + length] = b"\x01" * length
                items.update(who)


def _bit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % _FIELD


def _field(rarest: DataFrame) -> np.ndarray:
    """The bit field of all rarest words, put together from pieces that tasks make."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter(map(_bit, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(bits // _PIECE), pa.array(bits % _PIECE)], names=["piece", "bit"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for bits in batch.column(1):
                piece = np.zeros(_PIECE, bool)
                piece[bits.values.to_numpy()] = True
                made.append(np.packbits(piece).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["piece", "bits"])

    spread = rarest.select("word").distinct().mapInArrow(places, "piece long, bit long")
    listed = spread.groupBy("piece").agg(F.collect_set("bit").alias("bits")).mapInArrow(pieces, "piece long, bits binary")  # a set has _PIECE bits at most
    field = np.zeros(_FIELD // 8, np.uint8)
    for r in listed.toLocalIterator():
        field[r["piece"] * _PIECE // 8 : (r["piece"] + 1) * _PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return field


def _joined(rows: DataFrame, rarest: DataFrame, width: int, more: T.StructType) -> DataFrame:
    """The rows of ``find_overlaps`` by a shuffled join of windows and places."""
    field = rows.sparkSession.sparkContext.broadcast(_field(rarest))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "word", "place", "before", "around"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                bits = {w: field.value[(b := _bit(w)) >> 3] >> (7 - (b & 7)) & 1 for w in set(words)}
                for p in (i for i, w in enumerate(words) if bits[w]):
                    first = max(0, p - width + 1)
                    for column, value in zip(out, (row, words[p], p, p - first, words[first : p + width]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(words_of(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *batch.columns[2:]], names=["doc_id", "n_words", "row", *more.names])

    found = rows.select("row", "text").mapInArrow(places, "row long, word string, place int, before int, around array<string>")
    hits = found.join(rarest, "word").where("at <= before and slice(around, before - at + 1, size(words)) = words")
    runs = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct((F.col("place") - F.col("at")).alias("a"), (F.col("place") - F.col("at") + F.size("words")).alias("e")))).alias("runs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Runs come by their start: what each adds beyond the furthest end so far.
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    added = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(s["end"], r["a"]))).alias("n"), F.greatest(s["end"], r["e"]).alias("end"))
    runs = runs.select("row", F.aggregate("runs", none, added)["n"].cast("long").alias("n_hit"), "items")
    slim = rows.select("doc_id", "text", "row", *more.names).mapInArrow(sizes, T.StructType(ddl("doc_id long, n_words long, row long").fields + more.fields))
    both = slim.join(runs, "row", "left")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *more.names)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_bytes: int = 32 << 20, carry: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids, as strings), ``contaminated``.

    Null and empty texts have no words; items with a null id or text, or without
    a word, have no window; repeated items are one item; repeated documents are
    judged each; of equally rare words the first by its letters counts, which
    changes no result. Texts of any length are searched whole. Other columns are
    ignored, whatever their names, but with ``carry`` the whole input row comes
    along as a struct of that name. Empty documents give no rows, an empty
    benchmark no hits.
    """
    spark = docs.sparkSession
    along, more = carried(docs, carry)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *along)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    words = Written(items.select("text").mapInArrow(_distinct_words, "word string").distinct())
    windows = items.mapInArrow(_window_rows(width), "item string, words array<string>").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rarest = Written(_rarest(windows, _counts(rows, words.read()))).read()
    words.drop()
    bytes_of = lambda c: F.octet_length(F.array_join(c, " "))
    size = rarest.agg(F.coalesce(F.sum(bytes_of("words") + bytes_of("items") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(rows, rarest, width, more).withColumn("contaminated", F.col("n_hit") > 0)
    shared, name = spark.sparkContext.broadcast(rarest.toArrow()), uuid.uuid4().hex

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = resident(("windows", name), lambda: _index(shared.value))
        for batch in batches:
            texts = batch.column(1)
            sizes, hits, found = [], [], []
            for i in range(len(texts)):
                words = words_of(texts[i].as_py())
                who: set[str] = set()
                n = 0
                if not index.keys().isdisjoint(words):
                    marks = bytearray(len(words))
                    _probe(words, index, marks, who)
                    n = marks.count(1)
                sizes.append(len(words))
                hits.append(n)
                found.append(sorted(who))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]],
                names=["doc_id", "n_words", "n_hit", "items", *more.names],
            )

    schema = ddl("doc_id long, n_words long, n_hit long, items array<string>")
    out = rows.mapInArrow(probe, T.StructType(schema.fields + more.fields))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
