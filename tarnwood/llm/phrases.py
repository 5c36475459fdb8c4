"""Phrase collocations: word sequences that occur far more often than the parts they fall into.

Texts are cut into pieces at marks, and identical pieces become one row with a
multiplicity, so copies cost nothing from there on. Sequences are counted by
length, each count in hash buckets of (language, phrase): a task adds up the
weighted sequences of its own pieces, and duckdb adds up a bucket, spilling to
disk what does not fit its memory. A sequence can only be as frequent as
its parts, so longer ones are counted only where their parts are frequent, which
tasks see in a bit field of fixed size; what it lets through wrongly is
counted and falls at the threshold. The counts of a candidate's parts come by
lookup requests, shuffled to the part's bucket, and so do the counts of longer
phrases around it.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: The marks that end a piece.
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]+")
#: Bytes of pieces that a task holds before it gives out their counts.
_BYTES = 12 << 20
#: Cells of 64 bits in the field of frequent parts: 8 MB.
_CELLS = 1 << 20
#: Memory of one bucket's count; beyond it duckdb spills.
_MEMORY = "256MB"
#: Rows in an output batch.
_ROWS = 1 << 16
_SALTS = 16


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of texts with their multiplicities within a batch."""
    for batch in batches:
        found: Counter = Counter()
        texts = batch.column(1)
        for k, lang in enumerate(batch.column(0).to_pylist()):
            for piece in _CUT.split((texts[k].as_py() or "").encode().lower()):
                words = piece.split()
                if words:
                    found[lang, b" ".join(words)] += 1
        listed = list(found)
        for at in range(0, len(listed), _ROWS):
            part = listed[at : at + _ROWS]
            columns = [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[x] for x in part], pa.int64())], names=["lang", "piece", "m"])


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _set(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    cells = field[(hashes & np.uint64(_CELLS - 1)).astype(np.int64)]
    return (cells >> ((hashes >> np.uint64(20)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, the sum of its weights, and each place's key number."""
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    starts = np.nonzero(fresh)[0]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0], number


def _hash(lang: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{lang}\t{word}")


def _counted(lang: str, pieces: pa.Array, weights: np.ndarray, first: int, last: int, field: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The weighted sequences of some pieces of one language, those of equal words added up."""
    lists = pc.split_pattern(pieces, " ")
    size = lists.value_lengths().to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    code, words = found.indices.to_numpy().astype(np.int64), found.dictionary
    weight = np.repeat(weights, size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # words from here to the piece's end
    reach, whole = min(first - 1, 2) or 1, np.ones(len(code), bool)
    if field is not None:
        hashed = np.fromiter((_hash(lang, w) for w in words.to_pylist()), np.uint64, len(words))[code]
        if reach == 2:
            whole[:-1] = _set(field, _mixed(hashed[:-1], hashed[1:]))
        else:
            whole = _set(field, hashed)
    open_, number = whole & (room >= reach), code  # number: of the sequence from here, among those of its length
    for n in range(1, last + 1):
        if n > reach:  # the part that ends with the sequence
            open_[: len(code) - n + reach] &= whole[n - reach :]
            open_[max(0, len(code) - n + reach) :] = False
            open_ &= room >= n
        at = np.nonzero(open_)[0]
        if not len(at):
            return
        if n > 1:
            key = number[at] << 31 | code[at + n - 1]
            number = np.zeros(len(code), np.int64)
            chosen, sums, number[at] = _grouped(key, weight[at])
        elif first == 1:
            chosen, sums, _ = _grouped(code[at], weight[at])
        if n < first:
            continue
        at = at[chosen]
        for k in range(0, len(at), _ROWS):
            parts = [words.take(pa.array(code[at[k : k + _ROWS] + i])) for i in range(n)]
            phrases = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(sums[k : k + _ROWS])], names=["lang", "phrase", "n"])


def _sequences(first: int, last: int, field: Broadcast | None):
    """Weighted sequences of ``first`` to ``last`` words whose parts of ``first - 1`` words, two at the most, are all in ``field``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                rows = pa.Table.from_batches(parts).combine_chunks()
                pieces = rows.column("piece").combine_chunks()
                yield from _counted(lang, pieces, rows.column("m").to_numpy(), first, last, None if field is None else field.value)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, []).append(batch.filter(pc.equal(langs.indices, k)).select(["piece", "m"]))
            size += batch.column(1).nbytes
            if size >= _BYTES:
                yield from out()
                held, size = {}, 0
        if held:
            yield from out()

    return run


def _bucket(least: int):
    """Sums of the counts of a hash bucket, from ``least`` up, by duckdb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches := iter(batches), None)
        if first is None:
            return
        reader = pa.RecordBatchReader.from_batches(first.schema, chain([first], batches))
        # Spark's own folders for spill; what duckdb spills goes with the task.
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(prefix="bucket-", dir=local) as folder:
            settings = {"threads": 1, "memory_limit": _MEMORY, "temp_directory": folder, "preserve_insertion_order": False}
            with duckdb.connect(config=settings) as con:
                con.register("part", reader)
                yield from con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS f FROM part GROUP BY lang, phrase HAVING sum(n) >= {int(least)}").to_arrow_reader(_ROWS)

    return run


def _field(frequent: DataFrame, words: int) -> np.ndarray:
    """The bit field of frequent words, or pairs of words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, split = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
            parts = [np.fromiter((_hash(lang, p[k]) for lang, p in zip(langs, split, strict=True)), np.uint64, len(langs)) for k in range(words)]
            hashes = parts[0] if words == 1 else _mixed(*parts)
            mask = np.left_shift(np.uint64(1), hashes >> np.uint64(20) & np.uint64(63)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((hashes & np.uint64(_CELLS - 1)).astype(np.int64)), pa.array(mask)], names=["cell", "mask"])

    cells = frequent.select("lang", "phrase").mapInArrow(bits, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    found, field = cells.toArrow(), np.zeros(_CELLS, np.int64)  # _CELLS rows at most
    field[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return field.view(np.uint64)


def _exact(value: Column | str) -> Column:
    """A count in a type whose products do not overflow."""
    return F.col(value).cast("decimal(19,0)") if isinstance(value, str) else value.cast("decimal(19,0)")


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def _cuts(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """Candidates with their lowest-scoring cut: ``l``, ``r``, ``score``."""
    split = candidates.withColumn("w", F.split("phrase", " "))
    sides = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")) for k in range(1, longest) for side, part in (
        ("l", _part(F.lit(1), F.lit(k))), ("r", _part(F.lit(k + 1), F.greatest(F.size("w") - k, F.lit(0)))))]
    asked = split.select("lang", "phrase", "a", F.explode(F.filter(F.array(*sides), lambda s: s["k"] < F.size("w"))).alias("s"))
    asked = asked.select("lang", "phrase", "a", "s.k", "s.side", F.col("s.part").alias("part"))
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    both = told.groupBy("lang", "phrase", "a").agg(*[at(k, side).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"])
    options = []
    for k in range(1, longest):
        score = F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))")
        options.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    best = both.withColumn("best", F.array_min(F.array_compact(F.array(*options))))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _freestanding(candidates: DataFrame, inside: int, longest: int) -> DataFrame:
    """Candidates less those that stand, ``inside`` of 100 times or more, in one longer candidate."""
    split = candidates.withColumn("w", F.split("phrase", " "))
    within = [F.when((F.size("w") > n) & (F.size("w") >= i + n - 1), _part(F.lit(i), F.lit(n))) for n in range(2, longest) for i in range(1, longest - n + 2)]
    if not within:
        return candidates
    around = split.select("lang", F.explode(F.array_distinct(F.array_compact(F.array(*within)))).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    held = _exact(F.coalesce("around", F.lit(0))) * 100 >= _exact("a") * inside
    return candidates.join(around, ["lang", "phrase"], "left").where(~held).drop("around")


def mine_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """Each language's best phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Words are what lies between blanks and tabs, A-Z in lower case, within pieces
    that end at marks and line ends. A candidate is a sequence of 2 to
    ``longest`` words that occurs ``a`` >= ``least`` times; cut in two parts that
    occur ``l`` and ``r`` times it scores floor(2000000 a / (l + r)), and its lowest
    cut counts, of equals the earliest. A candidate of which a longer one holds
    ``inside`` of 100 occurrences or more is left out. ``n`` is the number of the
    language's words. Of equal scores the more frequent goes first, then
    the smaller by its UTF-8 bytes.

    A null language is ``und``; a null or empty text has no word; repeated rows
    count each; texts of any length are counted whole; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    pieces = Written(rows.mapInArrow(_pieces, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m")))
    known = pieces.read()

    def level(first: int, last: int, field: np.ndarray | None) -> DataFrame:
        shared = None if field is None else docs.sparkSession.sparkContext.broadcast(field)
        added = known.mapInArrow(_sequences(first, last, shared), "lang string, phrase string, n long")
        return Written(added.repartition("lang", "phrase").mapInArrow(_bucket(least), "lang string, phrase string, f long")).read()

    totals = known.groupBy("lang").agg(F.sum(F.col("m") * F.size(F.split("piece", " "))).alias("n"))
    levels = [level(1, 1, None)]
    levels.append(level(2, 2, _field(levels[0], 1)))
    if longest > 2:
        levels.append(level(3, longest, _field(levels[1], 2)))
    totals = Written(totals).read()
    pieces.drop()
    counts, candidates = levels[0], None
    for found in levels[1:]:
        counts = counts.unionByName(found)
        candidates = found if candidates is None else candidates.unionByName(found)
    candidates = candidates.withColumnRenamed("f", "a")
    scored = _cuts(_freestanding(candidates, inside, longest), counts, longest)
    # First among some of each language's phrases, then among what is left of them.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"))
