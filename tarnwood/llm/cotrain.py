"""Quality and toxicity by co-training of two views.

One view sees what a text says: its words, their beginnings and their shapes. The
other sees what is known of the page besides: language, source, and its build,
such as lengths, lines, variety of words, marks, bars and capitals. Each starts
from the labelled documents. In a round, each hands the other the unlabelled
documents that it is surest of, with its verdict as their label (Blum and
Mitchell, "Combining labeled and unlabeled data with co-training", 1998). The
views' scores are then calibrated and combined on labelled documents that neither
has been fitted on, and the combination scores every document.

All unlabelled documents take part: a hash of the id deals each into one round,
where the tasks score it with both views. A histogram of the scores tells from
where on a view's verdicts are among its surest, and only the documents beyond
that come to the driver, about ``handed`` a view and round, as in the algorithm as
published. So the rounds together read the documents once, and scoring reads them
a second time; no text is shuffled but those few. The labelled documents for the
fit are at most some ``max_labelled``, by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, carried, ddl, resident

_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)
#: Turns a feature's number into that of the same feature met in three distinct words or more.
_OFTEN = 0x5A5A5
_GROUP = 2 << 20
_MARKS = "#*$%&|<>"
#: Runs of letters, capitals, digits and marks that stand for one each in a word's shape.
_RUNS = ((r"\p{L}*[\p{Ll}\p{Lo}]\p{L}*", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0"), (r"([#*$%&|<>!?.])[#*$%&|<>!?.]+", r"\1+"))
#: Places in the metadata vector: languages, sources, six binned figures of ten bins, and variety of words by length.
_LANGS, _SOURCES, _BINS, _FIGURES = 16, 32, 10, 8
_META = _LANGS + _SOURCES + _FIGURES * _BINS + 100 + 1
TARGETS = ("quality", "toxic")


def _byte_table(change: dict[bytes, bytes]) -> np.ndarray:
    """What each byte becomes: any of a key's bytes the key's one byte, all others stay."""
    out = np.arange(256, dtype=np.uint8)
    for these, by in change.items():
        out[list(these)] = by[0]
    return out


#: ASCII letters, capitals and digits for which one of their kind may stand, as a word's shape knows the kinds only.
_KINDS = _byte_table({bytes(range(97, 123)): b"a", bytes(range(65, 91)): b"A", bytes(range(48, 58)): b"0"})
_IS_MARK = np.isin(np.arange(256), list(_MARKS.encode()))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of strings without nulls, end to end, and where each string begins and the last one ends."""
    _, places, data = strings.buffers()
    wide = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    begins = np.frombuffer(places, wide)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, wide)
    return np.frombuffer(data or b"", np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def _tally(there: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many bytes of each string are marked in ``there``."""
    return np.diff(np.searchsorted(np.flatnonzero(there), begins))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, once each, and where each begins among all of them sorted. A sort is faster here than ``np.unique``'s table."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[first], first


def _hashed(words: pa.Array, kind: int) -> np.ndarray:
    """Feature numbers of strings; ``kind`` keeps words, shapes and beginnings apart."""
    found = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    return ((found ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & _MASK).astype(np.int64)


def _shapes(words: pa.Array) -> pa.DictionaryArray:
    """The words with runs of a kind cut to one each; words that differ in their ASCII letters and digits only go through the patterns once."""
    data, begins = _bytes(words)
    kinds = type(words).from_buffers(len(words), pa.py_buffer(begins), pa.py_buffer(_KINDS[data])).dictionary_encode()
    shape = kinds.dictionary
    for pattern, by in _RUNS:
        shape = pc.replace_substring_regex(shape, pattern, by)
    return pa.DictionaryArray.from_arrays(kinds.indices, pc.utf8_slice_codeunits(shape, 0, 12))


def word_features(words: pa.Array) -> np.ndarray:
    """For each word the numbers of itself, its shape, and its first three and five letters; -1 where it is no longer than these."""
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?\"'()" + _MARKS)
    shapes = _shapes(words)
    out = [_hashed(plain, 0), _hashed(shapes.dictionary, 1)[shapes.indices.to_numpy()]]
    length = pc.utf8_length(plain).to_numpy()
    for n in (3, 5):
        begun = pc.utf8_slice_codeunits(plain, 0, n).dictionary_encode()
        out.append(np.where(length > n, _hashed(begun.dictionary, n)[begun.indices.to_numpy()], -1))
    return np.stack(out, 1)


@dataclass
class Measured:
    """Documents with their distinct words, and the metadata vectors."""

    documents: int
    words: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    meta: np.ndarray

    def features(self, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature number) once each, in order; a feature of three distinct words or more has a second number.

        ``used`` marks the numbers that matter; features without a mark on either of theirs are left out.
        """
        table = self.words
        if used is not None:
            table = np.where((table >= 0) & (used[table] | used[table ^ _OFTEN]), table, -1)
        some = (table >= 0).any(axis=1)[self.word]
        found = table[self.word[some]]
        key = (self.doc[some, None] << _BITS | found)[found >= 0]
        total = len(key)
        key, first = _distinct(key)
        often = key[np.diff(first, append=total) >= 3] ^ _OFTEN
        key = _distinct(np.append(key, often))[0] if len(often) else key
        return key >> _BITS, key & ((1 << _BITS) - 1)


def _binned(x: np.ndarray) -> np.ndarray:
    return np.clip((x * _BINS).astype(np.int64), 0, _BINS - 1)


def measure(langs: list, sources: list, texts: pa.Array) -> Measured:
    """What both views see of some documents. A null text is empty."""
    texts = texts.fill_null("")
    n = len(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists)))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    which, distinct = coded.indices.to_numpy(), max(1, len(coded.dictionary))
    pairs = _distinct(owner * distinct + which)[0]
    doc, word = pairs // distinct, pairs % distinct

    count = np.maximum(np.bincount(owner, minlength=n), 1)
    same = (which[1:] == which[:-1]) & (owner[1:] == owner[:-1])
    upper = np.asarray(pc.utf8_is_upper(coded.dictionary)) if len(coded.dictionary) else np.zeros(1, bool)
    data, begins = _bytes(texts)
    marks, barred = _tally(_IS_MARK[data], begins), _tally(data == ord("|"), begins) > 0
    bars = np.zeros(n, np.int64)
    bars[barred] = pc.count_substring(texts.filter(pa.array(barred)), " | ").to_numpy()
    ended = pc.count_substring_regex(texts, r"[.!?。！？][\"')]*(\n|$)").to_numpy()
    lines = _tally(data == ord("\n"), begins) + 1
    size = pc.utf8_length(texts).to_numpy()
    figures = [
        np.bincount(owner[1:][same], minlength=n) / count, np.bincount(owner, weights=upper[which], minlength=n) / count,
        marks / count, np.minimum(bars / lines, 0.99), np.minimum(ended / lines, 0.99), np.bincount(doc, minlength=n) / count,
        np.log2(size + 1) / 20, np.log2(size / lines + 1) / 16,
    ]
    meta = np.zeros((n, _META), np.float32)
    rows, at = np.arange(n), _LANGS + _SOURCES
    lang_of, source_of = ({x: hash_of(f"{kind} {x}") for x in set(values)} for kind, values in (("l", langs), ("s", sources)))
    meta[rows, [lang_of[x] % _LANGS for x in langs]] = 1
    meta[rows, [_LANGS + source_of[x] % _SOURCES for x in sources]] = 1
    for k, figure in enumerate(figures):
        meta[rows, at + k * _BINS + _binned(figure)] = 1
    meta[rows, at + _FIGURES * _BINS + 10 * _binned(figures[5]) + np.clip(np.log2(count).astype(np.int64) - 3, 0, 9)] = 1
    meta[:, -1] = 1
    return Measured(n, word_features(coded.dictionary) if len(coded.dictionary) else np.full((1, 4), -1), doc, word, meta)


def hash_of(text: str) -> int:
    return int(pd.util.hash_array(np.array([text], object), categorize=False)[0])


@dataclass
class Rows:
    """Sparse binary rows: feature numbers end to end, and where each row begins."""

    index: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        sizes = np.array([len(r) for r in rows], np.int64)
        return cls(np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32), np.cumsum(sizes) - sizes)

    def without_rare(self, least: int) -> Rows:
        """Without features of fewer than ``least`` rows."""
        common = (np.bincount(self.index, minlength=1 << _BITS) >= least)[self.index]
        owner = self.owner()[common]
        return Rows(self.index[common], np.searchsorted(owner, np.arange(len(self.begin))))

    def plus(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.index, other.index]), np.concatenate([self.begin, other.begin + len(self.index)]))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin), dtype=np.int32), np.diff(np.append(self.begin, len(self.index))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = (np.zeros(size) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class ContentView:
    """Logistic regression on the features that tell the classes apart best; few of the numbers have a weight."""

    def __init__(self, keep: int = 2000, least: int = 4, steps: int = 250):
        self.keep, self.least, self.steps = keep, least, steps
        self.chosen, self.values = np.empty(0, np.int32), np.empty(0, np.float32)
        self.bias = 0.0

    def weights(self) -> np.ndarray:
        """The weight of every feature number."""
        out = np.zeros(1 << _BITS, np.float32)
        out[self.chosen] = self.values
        return out

    def fit(self, rows: Rows, y: np.ndarray, used: np.ndarray) -> None:
        owner = rows.owner()
        mine = used[owner]
        index, owner = rows.index[mine], owner[mine]
        del mine
        there = np.bincount(index, minlength=1 << _BITS).astype(float)
        positive = np.bincount(index[y[owner] > 0], minlength=1 << _BITS)
        n, p = used.sum(), y[used].sum()
        expected = there * p / n
        chi = np.where(there >= self.least, (positive - expected) ** 2 / np.maximum(expected * (1 - p / n) * (1 - there / (n + 1)), 1e-9), 0)
        chosen = np.argsort(-chi, kind="stable")[: self.keep]
        chosen = chosen[chi[chosen] > 10.8]  # the 0.1 % level at one degree of freedom
        slot = np.full(1 << _BITS, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        s = slot[index]
        s, o = s[s >= 0], owner[s >= 0]
        del index, owner, there, positive, expected, chi, slot
        k = len(chosen)

        def gradient(w: np.ndarray) -> np.ndarray:
            z = np.bincount(o, weights=w[s], minlength=len(y)) + w[k]
            e = np.where(used, _sigmoid(z) - y, 0)
            return np.append(np.bincount(s, weights=e[o], minlength=k), e.sum()) / n + np.append(3e-5 * w[:k], 0)

        w = _adam(gradient, k + 1, self.steps, 0.2)
        self.chosen, self.values, self.bias = chosen.astype(np.int32), w[:k].astype(np.float32), float(w[k])

    def score(self, rows: Rows) -> np.ndarray:
        return np.bincount(rows.owner(), weights=self.weights()[rows.index], minlength=len(rows.begin)) + self.bias


class MetaView:
    """Logistic regression on the metadata vector."""

    def __init__(self, steps: int = 200):
        self.steps = steps
        self.weights = np.zeros(_META)

    def fit(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> None:
        xs, ys = x[used], y[used]
        self.weights = _adam(lambda w: xs.T @ (_sigmoid(xs @ w) - ys) / len(ys) + 1e-3 * w, _META, self.steps, 0.1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


@dataclass
class Verdict:
    """Two fitted views and how to combine their scores: weights of the content, of the metadata, and a constant."""

    content: ContentView
    meta: MetaView
    mix: np.ndarray

    def probability(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.mix[0] * c + self.mix[1] * m + self.mix[2])


class CoTraining:
    """Two views of one target, their labelled documents, and what they have been handed.

    Every fifth labelled document is held back, for the test of a teacher and the
    calibration. A view may teach a label only where its verdicts of ``sure``
    probability hold for that part of the documents held back.
    """

    def __init__(self, rows: Rows, meta: np.ndarray, labels: np.ndarray, sure: float = 0.95):
        self.data, self.sure, self.labels = [rows, meta], sure, labels
        self.held = np.zeros(len(labels), bool)
        self.held[::5] = True
        self.own = [labels.astype(float), labels.astype(float)]
        self.used = [~self.held, ~self.held]
        self.views = (ContentView(), MetaView())
        self.rate = labels[~self.held].mean()
        #: Documents handed over, by (teacher's number, label).
        self.handed = {(k, label): 0 for k in (0, 1) for label in (0, 1)}
        self.fit()

    def fit(self) -> None:
        for view, x, y, u in zip(self.views, self.data, self.own, self.used, strict=True):
            view.fit(x, y, u)

    def may_teach(self, k: int, label: int) -> bool:
        p = _sigmoid(self.views[k].score(self.data[k]))[: len(self.labels)][self.held]
        tried = (p if label else 1 - p) >= self.sure
        return tried.sum() >= 5 and (self.labels[self.held][tried] == label).mean() >= self.sure

    def take(self, data: list, given: list[np.ndarray]) -> None:
        """The documents with new ones after them, and the labels that each view is given for the new ones; -1 for none."""
        self.data = data
        for k in (0, 1):
            self.own[k] = np.append(self.own[k], np.maximum(given[k], 0))
            self.used[k] = np.append(self.used[k], given[k] >= 0)
            for label in (0, 1):
                self.handed[1 - k, label] += int((given[k] == label).sum())

    def verdict(self) -> Verdict:
        """The fitted views and the weights of their scores, by logistic regression on the documents held back."""
        n, held = len(self.labels), self.held
        both = np.stack([v.score(x)[:n] for v, x in zip(self.views, self.data, strict=True)] + [np.ones(n)], 1)[held]
        target, mix = self.labels[held], np.array([0.5, 0.5, 0.0])
        if len(np.unique(target)) == 2:
            scale = np.maximum(np.abs(both).max(axis=0), 1e-9)
            z, start = both / scale, mix * scale
            mix = (_adam(lambda w: z.T @ (_sigmoid(z @ (w + start)) - target) / len(target) + 1e-3 * w / scale, 3, 300, 0.1) + start) / scale
        return Verdict(*self.views, mix)


def _groups(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of some ``_GROUP`` bytes of text at a time; a longer text is a group of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _GROUP, "right")))
        yield batch.slice(first, last - first)
        first = last


def _gathered(picked: DataFrame) -> tuple[np.ndarray, Rows, np.ndarray]:
    """Ids, content features and metadata of a bounded set of documents, at the driver; of rows with one id, the least."""
    once = picked.groupBy("doc_id").agg(F.min(F.struct("lang", "source", "text")).alias("r")).select("doc_id", "r.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(("measures",), tuple)
        for batch in batches:
            for part in _groups(batch, 3):
                m = measure(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3))
                doc, feature = m.features()
                parts = np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, m.documents)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(parts, pa.list_(pa.int32())), pa.array(list(m.meta), pa.list_(pa.float32()))], names=["doc_id", "words", "meta"]
                )

    found = once.mapInArrow(work, "doc_id long, words array<int>, meta array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not len(found):
        return np.empty(0, np.int64), Rows.of([]), np.zeros((0, _META), np.float32)
    words, meta = (found[c].combine_chunks() for c in ("words", "meta"))
    sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
    out = found["doc_id"].to_numpy().copy(), Rows(words.flatten().to_numpy().copy(), np.cumsum(sizes) - sizes), meta.flatten().to_numpy().reshape(-1, _META).copy()
    del found, words, meta
    pa.default_memory_pool().release_unused()
    return out


def _scorer(shared, raw: bool, names: list[str]):
    """Each document's scores of both views for both targets; with ``raw`` those alone, else the calibrated probabilities before them.

    Columns: doc_id, lang, source, text, and any more, which come along.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(("measures",), tuple)  # lets go of what an operator before this one keeps
        verdicts, constant = shared.value
        known = [v for v in verdicts.values() if v]
        used, weights = np.zeros(1 << _BITS, bool), {t: v.content.weights() for t, v in verdicts.items() if v}
        for v in known:
            used[v.content.chosen] = True
        for batch in batches:
            for part in _groups(batch, 3):
                m = measure(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3))
                doc, feature = m.features(used)
                views, whole = [], []
                for t in TARGETS:
                    v = verdicts[t]
                    c = np.bincount(doc, weights=weights[t][feature], minlength=m.documents) + v.content.bias if v else np.zeros(m.documents)
                    x = v.meta.score(m.meta) if v else np.zeros(m.documents)
                    views += [c, x] if raw else [_sigmoid(c), _sigmoid(x)]
                    whole.append(v.probability(c, x) if v else np.full(m.documents, constant[t]))
                flat = [pa.array(c, pa.float64()) for c in (views if raw else whole + views)]
                yield pa.RecordBatch.from_arrays([part.column(0), *flat, *part.columns[4:]], names=names)

    return work


def _surest(scored: DataFrame, teachers: dict[str, tuple[str, int, int, float]], sure: float, handed: int) -> list[Column] | None:
    """Which documents each teacher hands over: a flag a teacher, or None if none of them is sure of any.

    ``teachers``: name -> (column of scores, sign, label, share). The best ``handed`` x share documents are taken by
    their bin of the score, and of the last bin as many as are still wanted, by a hash of the id.
    """
    bins = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(2 * sign * F.col(column)).cast("int").alias("bin")) for name, (column, sign, _, _) in teachers.items()])
    least = np.log(sure / (1 - sure))
    tall = scored.select(F.explode(bins).alias("b")).select("b.*").where(F.col("bin") >= int(np.ceil(2 * least)))
    counts: dict[str, dict[int, int]] = {name: {} for name in teachers}
    for r in tall.groupBy("name", F.least("bin", F.lit(80)).alias("bin")).agg(F.count("*").alias("n")).collect():
        counts[r["name"]][r["bin"]] = r["n"]
    flags = []
    for name, (column, sign, _, part) in teachers.items():
        wanted, last, share = max(1, round(handed * part)), None, 1.0
        for k in sorted(counts[name], reverse=True):
            last, share = k, min(1.0, wanted / counts[name][k])
            wanted -= counts[name][k]
            if wanted <= 0:
                break
        if last is None:
            flags.append(F.lit(False).alias(name))
            continue
        own = F.least(F.floor(2 * sign * F.col(column)), F.lit(80))
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 24)) < int(share * (1 << 24))
        flags.append(((own > last) | ((own == last) & drawn)).alias(name))
    return flags if any(counts.values()) else None


def _exchange(slim: DataFrame, labels: DataFrame, rows: Rows, meta: np.ndarray, known: dict[str, np.ndarray], rounds: int, handed: int, sure: float) -> dict[str, CoTraining]:
    """Co-training over all unlabelled documents, one part of them a round."""
    spark = slim.sparkSession
    trained = {t: CoTraining(rows, meta, y, sure) for t, y in known.items() if len(np.unique(y)) == 2 and len(np.unique(y[np.arange(len(y)) % 5 > 0])) == 2}
    names = ["doc_id", "content_quality", "meta_quality", "content_toxic", "meta_toxic"]
    for k in range(rounds):
        teachers = {}
        for t, c in trained.items():
            for view, title in enumerate(("content", "meta")):
                for label in (0, 1):
                    if c.may_teach(view, label):
                        teachers[f"{title}_{t}_{label}"] = (f"{title}_{t}", 1 if label else -1, label, c.rate if label else 1 - c.rate)
        if not teachers:
            break
        shared = spark.sparkContext.broadcast(({t: Verdict(*trained[t].views, np.zeros(3)) if t in trained else None for t in TARGETS}, dict.fromkeys(TARGETS, 0.0)))
        mine = slim.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == k)).select("doc_id", "lang", "source", "text")
        scores = Written(mine.mapInArrow(_scorer(shared, True, names), ddl("doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))))
        scored = scores.read().join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
        flags = _surest(scored, teachers, sure, handed)
        if flags is not None:
            chosen = scored.select("doc_id", *flags)
            some = " or ".join(f"`{n}`" for n in teachers)
            chosen = chosen.where(some).groupBy("doc_id").agg(*[F.bool_or(n).alias(n) for n in teachers]).toArrow()  # a small multiple of ``handed``
            picked = mine.join(F.broadcast(spark.createDataFrame(chosen.select(["doc_id"]))), "doc_id")
            ids, new_rows, new_meta = _gathered(picked)
            order = pc.index_in(pa.array(ids), value_set=chosen["doc_id"].combine_chunks())
            before = next(iter(trained.values())).data
            data = [before[0].plus(new_rows), np.concatenate([before[1], new_meta])]  # one for both targets
            for t, c in trained.items():
                given = [np.full(len(ids), -1), np.full(len(ids), -1)]
                for name, (column, _, label, _) in teachers.items():
                    if column.endswith(f"_{t}"):
                        told = chosen[name].combine_chunks().take(order).to_numpy(zero_copy_only=False)
                        given[1 if column.startswith("content") else 0][told.astype(bool)] = label
                c.take(data, given)
            del before, data, new_rows, new_meta
            for c in trained.values():
                c.fit()
        scores.drop()
        shared.destroy()
    return trained


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    max_labelled: int = 6000, rounds: int = 3, handed: int = 300, sure: float = 0.95, least_quality: float = 0.3, most_toxic: float = 0.3,
    carry: str | None = None, watch: dict | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``quality``, ``toxicity``, each view's scores, ``kept``.

    ``quality`` and ``toxicity`` are calibrated probabilities; kept are documents
    of ``least_quality`` or more and under ``most_toxic``. Null texts count as
    empty, null languages and sources as values of their own; null ids and
    labels take no part in fitting; of repeated labels the strictest holds, of
    documents with one id the least takes part in the fit. Equal scores at the
    edge of what is handed over are drawn by a hash of the id. Where a label has
    one class only, its probability is that class, and no document is rejected
    for it when there are no labels. Repeated rows are scored each; texts of any
    length are read whole; other columns are ignored, but with ``carry`` the
    whole input row comes along as a struct of that name; an empty table gives
    no rows. ``watch`` gets the co-trainings, for their counts of what was handed over.
    """
    along, more = carried(docs, carry)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), *along,
    )
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    sure_ones = labels.where("doc_id is not null and quality is not null and toxic is not null")
    marked = sure_ones.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    # A hash of the id draws the sample, so no task or driver sorts the labels.
    part = min(1.0, max_labelled / max(1, marked.count()))
    if part < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 24)) < int(part * (1 << 24)))
    marks = marked.toArrow()  # some ``max_labelled`` rows
    picked = slim.join(F.broadcast(slim.sparkSession.createDataFrame(marks.select(["doc_id"])) if len(marks) else marked.select("doc_id").limit(0)), "doc_id")
    ids, rows, meta = _gathered(picked.select("doc_id", "lang", "source", "text"))
    order = pc.index_in(pa.array(ids), value_set=marks["doc_id"].combine_chunks()) if len(ids) else None
    rows = rows.without_rare(ContentView().least)  # which no view uses
    known = {t: marks[t].combine_chunks().take(order).to_numpy().astype(np.int64) if len(ids) else np.empty(0, np.int64) for t in TARGETS}
    trained = _exchange(slim, labels, rows, meta, known, rounds, handed, sure) if len(ids) else {}
    if watch is not None:
        watch.update(trained)
    constant = {"quality": 1.0, "toxic": 0.0} | {t: float(y.mean()) for t, y in known.items() if len(y) and t not in trained}
    verdicts = {t: trained[t].verdict() if t in trained else None for t in TARGETS}
    shared = slim.sparkSession.sparkContext.broadcast((verdicts, constant))
    names = ["doc_id", "quality", "toxicity", "content_quality", "meta_quality", "content_toxicity", "meta_toxicity"]
    schema = ddl("doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))
    out = slim.mapInArrow(_scorer(shared, False, names + more.names), T.StructType(schema.fields + more.fields))
    return out.withColumn("kept", (F.col("quality") >= least_quality) & (F.col("toxicity") < most_toxic))
