"""Keyword search by stems and proximity, with a trigram fallback, over texts as they are or over an index.

A document is found if it holds all words of a query in any of their forms
(words of one English stem). Its rank is that of a proximity search: two words of
the query count more the closer they stand, one word alone counts with its
occurrences, and the sum r becomes r / (r + 1).

``TextIndex`` keeps postings by word and by trigram, cut into blocks of documents
with their largest counts. A search reads only the buckets of its own words, and
of those only the blocks whose best possible score still matters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STOP, stem
from ..functions.texts import trigram_similarity, trigrams

_WORD = re.compile("[a-z0-9]+")
#: Fixed values of the rank: a word's weight, the last place that counts, places kept of one word, and the sum of 1/i^2.
_WEIGHT, _LAST, _MOST, _SERIES = 0.1, 16383, 255, 1.64493406685
#: Documents in a block of the index; buckets of the words; blocks that a search looks at first.
_DOCS, _BUCKETS, _FIRST = 4096, 64, 64
#: Words whose stems a task of a scan keeps at a time.
_KNOWN = 1 << 16


def terms(text: Column) -> Column:
    """Lower-case alphanumeric words of a text, without stop words."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(found, lambda w: (w != "") & ~w.isin(*sorted(STOP)))


def query_stems(query: str) -> list[str]:
    """The distinct stems of a query's words."""
    return sorted({stem(w) for w in _WORD.findall(query.lower()) if w not in STOP})


def word_places(text: str | None) -> dict[str, list[int]]:
    """Word -> its places in a text, counted from 1 over all words; stop words have places but no entry."""
    found: dict[str, list[int]] = {}
    for place, word in enumerate(_WORD.findall((text or "").lower()), 1):
        if word not in STOP:
            found.setdefault(word, []).append(place)
    return found


def _kept(places: list[int]) -> list[int]:
    """The places of one stem that count: late ones as one, and not more than ``_MOST``."""
    return sorted({min(p, _LAST) for p in places})[:_MOST]


def closeness(distance: np.ndarray) -> np.ndarray:
    """What two words at a distance of some places add to a rank."""
    far = distance > 100
    near = np.exp(np.where(far, 0, distance) / 1.5 - 2)
    return _WEIGHT * np.sqrt(np.where(far, 1e-30, 1 / (1.005 + 0.05 * near)))


def text_rank(places: list[list[int]]) -> float:
    """The rank of a text from the places of each stem of the query in it."""
    kept = [_kept(p) for p in places]
    if len(kept) == 1:
        return sum(_WEIGHT / i**2 for i in range(1, len(kept[0]) + 1)) / _SERIES
    rest = 0.0
    for k, a in enumerate(kept):
        for b in kept[k + 1 :]:
            distance = np.abs(np.subtract.outer(np.array(a), np.array(b)))
            rest += np.log1p(-closeness(distance[distance > 0])).sum()
    return -math.expm1(rest)


def most_rank(counts: list[int]) -> float:
    """What a text can rank at the most, by how often it holds each stem."""
    counts = [min(n, _MOST) for n in counts]
    if len(counts) == 1:
        return text_rank([list(range(1, counts[0] + 1))])
    pairs = sum(a * b for k, a in enumerate(counts) for b in counts[k + 1 :])
    return -math.expm1(pairs * math.log1p(-float(closeness(np.array([1.0]))[0])))


def _score(rank: float) -> float:
    return math.floor(rank / (rank + 1) * 1e9 + 0.5) / 1e9


def postings(docs: DataFrame, *, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(``term``, ``id``, ``tf``, ``length``): how often each word stands in each text, and the words of the text."""
    counted = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("length", F.size("t"))
    return counted.select("id", "length", F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def updated_postings(index: DataFrame, changed: DataFrame, *, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The index with the postings of ``changed`` rows in place of those that they had; the other rows' are not read again."""
    fresh = postings(changed, id_col=id_col, text_col=text_col)
    return index.join(changed.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti").select(*index.columns).unionByName(fresh)


def fts_topk(docs: DataFrame, query: str, limit: int, *, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(``id``, ``score``) of the best documents that hold all stems of ``query``; ties by id.

    One scan; a task keeps the stems of the words it has met.
    """
    wanted = query_stems(query)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not wanted:
        return named.select("id", F.lit(0.0).alias("score")).limit(0)
    number = {s: k for k, s in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int | None] = {}
        for batch in batches:
            rows, scores, texts = [], [], batch.column(1)
            for k in range(batch.num_rows):
                places: list[list[int]] = [[] for _ in wanted]
                for place, word in enumerate(_WORD.findall((texts[k].as_py() or "").lower()), 1):
                    if word not in known:
                        if len(known) >= _KNOWN:
                            known.clear()
                        known[word] = None if word in STOP else number.get(stem(word))
                    which = known[word]
                    if which is not None:
                        places[which].append(place)
                if all(places):
                    rows.append(k)
                    scores.append(_score(text_rank(places)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = named.mapInArrow(run, named.select("id", F.lit(0.0).alias("score")).schema)
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def trigram_topk(docs: DataFrame, query: str, limit: int, *, id_col: str = "id", text_col: str = "content", least: float = 0.3) -> DataFrame:
    """(``id``, ``score``) of the texts most similar to ``query`` by trigrams, from ``least`` up."""
    scored = docs.select(F.col(id_col).alias("id"), F.round(trigram_similarity(F.col(text_col), F.lit(query)), 9).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def keyword_topk(docs: DataFrame, query: str, limit: int, *, id_col: str = "id", text_col: str = "content", full_text: bool = True) -> DataFrame:
    """Full-text search where the table has it; by trigrams where it has not or finds nothing."""
    if full_text:
        found = fts_topk(docs, query, limit, id_col=id_col, text_col=text_col)
        rows = found.collect()  # ``limit`` rows at most, searched for once
        if rows:
            return docs.sparkSession.createDataFrame(rows, found.schema)
    return trigram_topk(docs, query, limit, id_col=id_col, text_col=text_col)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, id, block, places) of some texts; a batch's rows are given out some megabytes at a time."""
    for batch in batches:
        words, rows, places, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.list_(pa.int32()))], names=["term", "id", "block", "places"])  # noqa: B023

        texts = batch.column(2)
        for k in range(batch.num_rows):
            for word, found in word_places(texts[k].as_py()).items():
                words.append(word)
                rows.append(k)
                places.append(found)
                size += len(found) + 8
            if size > 1 << 20:
                yield out()
                words, rows, places, size = [], [], [], 0
        if rows:
            yield out()


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(map(stem, batch.column(0).to_pylist())), pa.string()), batch.column(0)], names=["stem", "term"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndex:
    """Postings of one table's texts in a folder: ``words``, ``grams`` and ``stems``, each dealt into buckets by key.

    A posting row is a block of documents for one word, with the largest count in
    it; blocks are drawn by the document's id, so those of several words line up,
    and no row grows with the word's frequency. The stemmer runs once for each
    distinct word. Documents without an id are not found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = _BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, docs: DataFrame, *, id_col: str = "id", text_col: str = "content", grams: bool = True, block_docs: int = _DOCS) -> TextIndex:
        """Write the index of ``docs``; the folder must not exist."""
        named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
        named.select("id").limit(0).write.parquet(f"{self.path}/ids")  # the type of the ids
        blocks = max(1, -(-named.count() // block_docs))
        named = named.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "text")
        rows = named.mapInArrow(_word_rows, named.select(F.lit("").alias("term"), "id", "block", F.array(F.lit(0)).alias("places")).schema)
        grouped = self._dealt(rows, "term").groupBy("slot", "bucket", "term", "block")
        self._write("words", grouped.agg(F.max(F.size("places")).alias("most"), F.collect_list(F.struct("id", "places")).alias("docs")), "term")
        words = self._rows("words").select("term").distinct().mapInArrow(_stemmed, "stem string, term string")
        self._write("stems", self._dealt(words, "stem"), "stem")
        if grams:
            sets = named.select("id", "block", trigrams(F.col("text")).alias("g")).withColumn("n", F.size("g"))
            spread = sets.select("id", "block", "n", F.explode("g").alias("gram"))
            listed = self._dealt(spread, "gram").groupBy("slot", "bucket", "gram", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("df"), F.collect_list(F.struct("id", "n")).alias("docs"))
            self._write("grams", listed, "gram")
        return self

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows with their ``bucket``, dealt by parts of it (``slot``), so that what is grouped by slot and key need not be moved again."""
        slots = rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(7 * self.buckets)).cast("int")).repartition("slot")
        return slots.withColumn("bucket", F.col("slot") % self.buckets)

    def _write(self, name: str, rows: DataFrame, key: str) -> None:
        rows.drop("slot").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _none(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ids").select("id", F.lit(0.0).alias("score")).limit(0)

    def _rows(self, name: str) -> DataFrame:
        docs = {"words": "struct<id:{}, places:array<int>>", "grams": "struct<id:{}, n:int>"}.get(name, "").format(self._none().schema["id"].dataType.simpleString())
        fields = {"words": f"term string, block int, most int, docs array<{docs}>", "stems": "stem string, term string", "grams": f"gram string, block int, least int, most int, df long, docs array<{docs}>"}[name]
        return self.spark.read.schema(f"{fields}, bucket int").parquet(f"{self.path}/{name}")

    def _of(self, name: str, key: str, values: list[str]) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(v,) for v in values], "v string").select(_bucket(F.col("v"), self.buckets).alias("b")).distinct().collect()
        return self._rows(name).where(F.col("bucket").isin([r["b"] for r in wanted]) & F.col(key).isin(values))

    def _postings(self, wanted: list[str]) -> DataFrame | None:
        """The blocks of all words of the query's stems, with the number ``k`` of the stem; None if a stem has no word."""
        forms = self._of("stems", "stem", wanted).collect()  # the forms of some words
        number = {r["term"]: wanted.index(r["stem"]) for r in forms}
        if len(set(number.values())) < len(wanted):
            return None
        of = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
        return self._of("words", "term", list(number)).withColumn("k", of[F.col("term")])

    def bounds(self, query: str) -> DataFrame:
        """(``block``, ``bound``) of the blocks that hold all stems of a query: no document of a block scores more. Reads no document."""
        wanted = query_stems(query)
        rows = self._postings(wanted) if wanted else None
        if rows is None:
            return self.spark.createDataFrame([], "block int, bound double")
        return _bounds(rows, len(wanted))

    def search(self, query: str, limit: int) -> DataFrame:
        """What ``fts_topk`` gives over the indexed documents.

        The blocks of highest bound are ranked first; of the others those whose
        bound reaches the last score found, and no more, are read at all.
        """
        wanted = query_stems(query)
        rows = self._postings(wanted) if wanted else None
        if rows is None:
            return self._none()
        bounds = _bounds(rows, len(wanted))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(_FIRST).collect()]
        best = _ranked(rows.where(F.col("block").isin(first)), len(wanted)).orderBy(F.desc("score"), "id").limit(limit)
        found = best.collect()  # ``limit`` rows at most
        held = self.spark.createDataFrame(found, best.schema)
        if len(first) < _FIRST:
            return held
        least = found[-1]["score"] if len(found) == limit else 0.0
        left = bounds.where((F.col("bound") >= least) & ~F.col("block").isin(first)).select("block")
        more = _ranked(rows.join(left, "block", "left_semi"), len(wanted))
        return held.unionByName(more).orderBy(F.desc("score"), "id").limit(limit)

    def _grams(self, query: str, least: float) -> tuple[DataFrame, list[str], int] | None:
        """The blocks of the query's trigrams that hold texts of a fitting size, the trigrams by rarity, and how many of them a similar text shares at the least."""
        grams = self.spark.range(1).select(trigrams(F.lit(query)).alias("g")).first()["g"]
        if not grams:
            return None
        low, high = math.ceil(least * len(grams) - 1e-9), math.floor(len(grams) / least + 1e-9)
        rows = self._of("grams", "gram", grams).where((F.col("least") <= high) & (F.col("most") >= low))
        counts = {r["gram"]: r["df"] for r in rows.groupBy("gram").agg(F.sum("df").alias("df")).collect()}
        shared = math.ceil(least * (low + len(grams)) / (1 + least) - 1e-9)
        spread = rows.select("gram", F.explode("docs").alias("d")).select("gram", "d.id", "d.n").where(F.col("n").between(low, high))
        return spread, sorted(grams, key=lambda g: (counts.get(g, 0), g)), max(1, shared)

    def candidates(self, query: str, least: float = 0.3) -> DataFrame:
        """(``id``, ``n``, ``c``): texts of a fitting size that share ``c`` of the query's rarer trigrams.

        A text as similar as ``least`` shares some number t of the query's m trigrams,
        so it has one of the m - t + 1 rarest; the lists of the others are not gone
        through for candidates.
        """
        found = self._grams(query, least)
        if found is None:
            return self._none().select("id", F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"))
        spread, grams, shared = found
        return spread.where(F.col("gram").isin(grams[: len(grams) - shared + 1])).groupBy("id", "n").agg(F.count("*").alias("c"))

    def similar(self, query: str, limit: int, least: float = 0.3) -> DataFrame:
        """What ``trigram_topk`` gives over the indexed documents."""
        found = self._grams(query, least)
        if found is None:
            return self._none()
        spread, grams, shared = found
        some = self.candidates(query, least)
        frequent = spread.where(F.col("gram").isin(grams[len(grams) - shared + 1 :])).join(some.select("id"), "id", "left_semi")
        both = some.unionByName(frequent.groupBy("id", "n").agg(F.count("*").alias("c"))).groupBy("id", "n").agg(F.sum("c").alias("c"))
        score = F.round(F.col("c") / (F.col("n") + len(grams) - F.col("c")), 9)
        return both.select("id", score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)

    def keyword(self, query: str, limit: int) -> DataFrame:
        """What ``keyword_topk`` gives: by trigrams where the words find nothing."""
        found = self.search(query, limit)
        rows = found.collect()  # ``limit`` rows at most
        return self.spark.createDataFrame(rows, found.schema) if rows else self.similar(query, limit)


def _bounds(rows: DataFrame, stems: int) -> DataFrame:
    """(``block``, ``bound``) of the blocks that hold all stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = [_score(most_rank([x["most"] for x in held])) + 1e-9 for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds, pa.float64())], names=["block", "bound"])

    by_stem = rows.groupBy("block", "k").agg(F.sum("most").cast("int").alias("most"))
    by_block = by_stem.groupBy("block").agg(F.collect_list(F.struct("k", "most")).alias("held")).where(F.size("held") == stems)
    return by_block.mapInArrow(run, "block int, bound double")


def _ranked(rows: DataFrame, stems: int) -> DataFrame:
    """(``id``, ``score``) of the documents of some blocks that hold all stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_score(text_rank([x["places"] for x in held])) for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    spread = rows.select("k", F.explode("docs").alias("d")).select("k", "d.id", "d.places")
    by_stem = spread.groupBy("id", "k").agg(F.flatten(F.collect_list("places")).alias("places"))
    held = by_stem.groupBy("id").agg(F.collect_list(F.struct("k", "places")).alias("held")).where(F.size("held") == stems)
    return held.mapInArrow(run, held.select("id", F.lit(0.0).alias("score")).schema)
