"""Masked pseudo-likelihood by a bidirectional window network.

For every token the network sees the ``reach`` tokens on either side and not the
token itself, and gives a distribution over the vocabulary; a document's score is
the sum of its tokens' conditional log-probabilities (Besag's pseudo-likelihood;
Salazar et al., "Masked language model scoring", 2020).

The vocabulary holds the most frequent words of all documents; every other word
falls into one of a few hash classes, so each token of each text is predicted.
The output layer is a two-level softmax over ``side`` groups of ``side`` words.
A word of a class has the class's conditional probability times its own within
the class, from the counts of all words of all documents, smoothed (class-based
models: Brown et al., 1992). Words are told apart there by 63-bit hashes.

Training is numpy in the tasks, in rounds (local steps and averaging: McMahan et
al., "Communication-efficient learning of deep networks from decentralized data",
2017). Documents are dealt into shards of about ``shard_tokens`` tokens and into
rounds by a hash of id and text. In a round every shard starts from the common
model, trains on its documents of that round, and the copies are averaged,
weighted by their tokens. Every token is a target in exactly one round. Shards
depend on the rows alone, so how a table is cut into files or partitions changes
nothing, and a shard's work does not shrink as the corpus grows. The first model
is the unigram distribution: its output biases are the words' log-frequencies.
What is gathered, word counts and models, grows with the corpus; the driver sees
one averaged model of fixed size a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORD, Written, lower_ascii

_BLOCKS = 32
_MERGE = 64
_RARE = 1 << 63
_MARKS = ".,;:!?\"'()"


def tokens(text: str | None) -> list[str]:
    """Lower-cased words, with the marks around them."""
    return ASCII_WORD.findall(lower_ascii(text)) if text else []


def bare(word: str) -> str:
    """A word without the marks around it; marks alone stay."""
    return word.strip(_MARKS) or word


def without_marks(words: pa.Array) -> pa.Array:
    """``bare`` for an array of words."""
    plain = pc.utf8_trim(words, characters=_MARKS)
    return pc.if_else(pc.equal(pc.binary_length(plain), 0), words, plain)


class Vocabulary:
    """Word -> number: frequent words have their own, others share ``classes`` by hash. Marks around a word do not count."""

    def __init__(self, words: list[str], size: int):
        self.frequent = pa.array(words, pa.string())
        self.first, self.classes = len(words), size - len(words)

    def codes(self, words: pa.Array) -> np.ndarray:
        """For words without marks: the number of a frequent one, ``_RARE`` + 63 bits of hash for any other."""
        place = pc.index_in(words, value_set=self.frequent)
        rare = np.asarray(place.is_null())
        out = place.fill_null(0).to_numpy().astype(np.uint64)
        others = words.filter(pa.array(rare)).cast(pa.binary()).to_numpy(zero_copy_only=False)
        out[rare] = np.fromiter(map(xxhash.xxh3_64_intdigest, others), np.uint64, len(others)) | np.uint64(_RARE)
        return out

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of codes: that of a hash class for a rare one."""
        return np.where(codes >= _RARE, codes % np.uint64(self.classes or 1) + np.uint64(self.first), codes).astype(np.int32)


#: Steps of a hidden value between 0 and 1, as scores take it.
_STEPS = 256


class WindowNetwork:
    """The network's parameters in one flat array, with the passes over a batch of tokens."""

    def __init__(self, side: int = 64, width: int = 16, reach: int = 2, seed: int = 7):
        self.side, self.width, self.reach = side, width, reach
        self.size = side * side
        shapes = {
            "embed": (self.size + 1, width), "place": (2 * reach, width), "group": (width, side), "group_bias": (side,),
            "word": (side, width, side), "word_bias": (side, side),
        }
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
        self.names, at, rng = {}, 0, np.random.default_rng(seed)
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.names[name] = (at, shape)
            view = self.flat[at : at + n].reshape(shape)
            if name == "place":
                view[:] = 1
            elif not name.endswith("bias"):
                view[:] = rng.normal(0, 0.3, shape)
            at += n
        self.get("embed")[self.size] = 0

    def start_at(self, counts: np.ndarray) -> None:
        """Output biases from the words' counts, and small weights: the unigram distribution, near enough."""
        by_group = (counts + 0.5).reshape(self.side, self.side)
        own = by_group.sum(axis=1)
        self.get("group_bias")[:] = np.log(own / own.sum())
        self.get("word_bias")[:] = np.log(by_group / own[:, None])
        for name in ("group", "word"):
            self.get(name)[:] *= 0.1

    def get(self, name: str, flat: np.ndarray | None = None) -> np.ndarray:
        at, shape = self.names[name]
        return (self.flat if flat is None else flat)[at : at + int(np.prod(shape))].reshape(shape)

    def around(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each token the numbers of its neighbours; ``size`` beyond its document."""
        out = np.full((len(ids), 2 * self.reach), self.size, np.int32)
        for k, step in enumerate([*range(-self.reach, 0), *range(1, self.reach + 1)]):
            to = slice(max(0, -step), len(ids) - max(0, step))
            of = slice(max(0, step), len(ids) - max(0, -step))
            if len(ids) > abs(step):
                out[to, k] = np.where(owner[to] == owner[of], ids[of], self.size)
        return out

    @staticmethod
    def _chosen(z: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
        """Log-softmax of each row at one place; overwrites ``z``. ``safe``: no entry's exponential can overflow."""
        if not safe:
            z -= z.max(axis=1, keepdims=True)
        mine = z[np.arange(len(z)), at]
        return mine - np.log(np.exp(z, out=z).sum(axis=1))

    def _by_group(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in the order of their groups, and where each group ends; a radix sort, as the numbers are small."""
        order = np.argsort(g.astype(np.uint16), kind="stable")
        return order, np.append(0, np.cumsum(np.bincount(g, minlength=self.side)))

    def _gridded(self, weights: np.ndarray) -> np.ndarray:
        """One output's weights on a grid so coarse that their products with hidden values in steps of 1 / ``_STEPS`` add up exactly in float32."""
        step = 2.0 ** np.ceil(np.log2(max(float(np.abs(weights).max()), 1e-9) * self.width * _STEPS / 2**22))
        return (np.rint(weights / step) * step).astype(np.float32)

    def log_probability(self, ids: np.ndarray, near: np.ndarray, chunk: int = 16_384, rounded: bool = False) -> np.ndarray:
        """log P(token | its neighbours) for each token.

        A matrix product's sums come in an order that depends on where a row stands
        among others. With ``rounded``, hidden values and weights are taken on grids
        on which no sum is ever rounded, so that a token's value depends on its
        window alone.
        """
        out = np.empty(len(ids), np.float64)
        group_w, group_b, word_w, word_b = (self.get(n) for n in ("group", "group_bias", "word", "word_bias"))
        if rounded:
            group_w, word_w = self._gridded(group_w), np.stack(list(map(self._gridded, word_w)))
        # |h| is at most 1, so a logit is at most its column's absolute sum.
        safe = [float((np.abs(w).sum(axis=0) + np.abs(b)).max()) < 60 for w, b in [(group_w, group_b), *zip(word_w, word_b, strict=True)]]
        placed = [self.get("embed") * p for p in self.get("place")]
        held = np.empty((min(chunk, len(ids)), self.side), self.flat.dtype)
        for at in range(0, len(ids), chunk):
            i, n = ids[at : at + chunk], near[at : at + chunk]
            h = placed[0].take(n[:, 0], axis=0)
            for k in range(1, n.shape[1]):
                h += placed[k].take(n[:, k], axis=0)
            np.tanh(h, out=h)
            if rounded:
                h *= _STEPS
                np.rint(h, out=h)
                h /= _STEPS
            g, w = np.divmod(i, self.side)
            z = np.matmul(h, group_w, out=held[: len(i)])
            z += group_b
            score = self._chosen(z, g, safe[0]).astype(np.float64)
            order, ends = self._by_group(g)
            h, w = h.take(order, axis=0), w[order]
            words = np.empty(len(i), np.float64)
            for c in np.flatnonzero(np.diff(ends)):
                own = slice(ends[c], ends[c + 1])
                z = np.matmul(h[own], word_w[c], out=held[: ends[c + 1] - ends[c]])
                z += word_b[c]
                words[own] = self._chosen(z, w[own], safe[c + 1])
            score[order] += words
            out[at : at + chunk] = score
        return out

    @staticmethod
    def _errors(z: np.ndarray, at: np.ndarray, safe: bool, parts: list[slice]) -> None:
        """Turns ``z`` into the softmax of each row less one at one place, the gradient of its loss. ``parts``: rows whose sums are taken in one product."""
        if not safe:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        sums, ones = np.empty(len(z), z.dtype), np.ones(z.shape[1], z.dtype)
        for own in parts:
            np.matmul(z[own], ones, out=sums[own])
        z *= (1 / sums)[:, None]
        z[np.arange(len(z)), at] -= 1

    def train(self, ids: np.ndarray, near: np.ndarray, squares: np.ndarray, rate: float, chunk: int = 4096) -> None:
        """Adagrad steps over the tokens in order, ``chunk`` at a time."""
        grad, step = np.empty_like(self.flat), np.empty_like(self.flat)
        # Arrays of the chunks, made once.
        most, slots = min(chunk, len(ids)), near.shape[1]
        founds, spreads, gathered = (np.empty((most, slots, self.width), self.flat.dtype) for _ in range(3))
        errors, backs = np.empty((most, self.side), self.flat.dtype), np.empty((most, self.width), self.flat.dtype)
        embed, place, group, group_b, word, word_b = (self.get(n) for n in self.names)
        d_embed, d_place, d_group, d_group_b, d_word, d_word_b = (self.get(n, grad) for n in self.names)
        for at in range(0, len(ids), chunk):
            i, n = ids[at : at + chunk], near[at : at + chunk]
            grad[:] = 0
            # |h| is at most 1, so a logit is at most its column's absolute sum.
            safe = [float((np.abs(x).sum(axis=-2) + np.abs(b)).max()) < 60 for x, b in ((group, group_b), (word, word_b))]
            g, w = np.divmod(i, self.side)
            order, ends = self._by_group(g)
            g, w, n = g[order], w[order], n[order]
            # A group's products go to its rows of one array, so that all else is done once for all groups.
            parts = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(np.diff(ends)).tolist()]
            rows = n.ravel()
            found, spread, e, back = founds[: len(i)], spreads[: len(i)], errors[: len(i)], backs[: len(i)]
            embed.take(rows, axis=0, out=found.reshape(-1, self.width), mode="clip")
            h = found[:, 0] * place[0]
            for k in range(1, n.shape[1]):
                h += found[:, k] * place[k]
            np.tanh(h, out=h)
            np.matmul(h, group, out=e)
            e += group_b
            self._errors(e, g, safe[0], [slice(0, len(i))])
            np.matmul(h.T, e, out=d_group)
            np.add.reduce(e, axis=0, out=d_group_b)
            dh = e @ group.T
            for c, own in parts:
                np.matmul(h[own], word[c], out=e[own])
            e += word_b.take(g, axis=0)
            self._errors(e, w, safe[1], [own for _, own in parts])
            for c, own in parts:
                np.matmul(h[own].T, e[own], out=d_word[c])
                np.add.reduce(e[own], axis=0, out=d_word_b[c])
                np.matmul(e[own], word[c].T, out=back[own])
            dh += back
            dh *= 1 - h * h
            found *= dh[:, None]
            found.sum(axis=0, out=d_place)
            by = np.argsort(rows.astype(np.uint16) if self.size < 1 << 16 else rows, kind="stable")
            ordered = rows[by]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            np.multiply(dh[:, None], place, out=spread)
            sorted_ = gathered[: len(i)].reshape(-1, self.width)
            spread.reshape(-1, self.width).take(by, axis=0, out=sorted_, mode="clip")
            d_embed[ordered[first]] = np.add.reduceat(sorted_, first, axis=0)
            d_embed[self.size] = 0
            grad /= len(i)
            squares += np.multiply(grad, grad, out=step)
            np.sqrt(squares, out=step)
            step += 1e-4
            np.divide(grad, step, out=step)
            step *= rate
            self.flat -= step


def _groups(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Texts some ``most`` bytes at a time, each group with its first row; a longer text is a group of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many tokens each text has, and all of them end to end: lower-cased words, with the marks around them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    full = np.asarray(pc.binary_length(words)) > 0  # blanks at a text's ends leave empty ones
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))[full]
    return np.bincount(owner, minlength=len(texts)), words.filter(pa.array(full)).dictionary_encode()


def _coded(texts: pa.Array, vocabulary: Vocabulary, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Documents in groups: first row, tokens of each, all tokens' codes."""
    for first, part in _groups(texts, most):
        counts, words = split_words(part)
        yield first, counts, vocabulary.codes(without_marks(words.dictionary))[words.indices.to_numpy()]


def _weighted_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, part): the mean of the values of each, weighted by tokens."""
    key, total, weight = None, None, 0.0

    def row() -> pa.RecordBatch:
        mean = (total / max(weight, 1e-9)).astype(np.float32)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([mean.tobytes()], pa.binary())],
            names=["block", "part", "weight", "parameters"],
        )

    for batch in batches:
        for block, part, w, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (block, part) != key:
                if key is not None:
                    yield row()
                key, total, weight = (block, part), 0.0, 0.0
            total = total + w * np.frombuffer(p, np.float32).astype(np.float64)
            weight += w
    if key is not None:
        yield row()


class Fitted(NamedTuple):
    """The vocabulary's words, the network, and tokens and distinct words of each hash class in the documents of the fit."""

    words: list[str]
    network: WindowNetwork
    class_tokens: np.ndarray
    class_types: np.ndarray


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _groups(batch.column(0), 8 << 20):
            _, words = split_words(texts)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([without_marks(words.dictionary), pa.array(n, pa.int64())], names=["word", "n"])


def _frequent(counted: DataFrame, most: int) -> list[tuple[str, int]]:
    """The ``most`` most frequent words, ties by word.

    A histogram by size finds a count that little more than ``most`` words reach,
    so tasks send those only and not the best of each.
    """
    size = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 0
    for r in sorted(counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held, least = held + r["words"], r["size"]
        if held >= most:
            break
    return [(r["word"], r["n"]) for r in counted.where(size >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def _class_totals(counted: DataFrame, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each hash class."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words, size)
        tokens_, types = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            number = vocabulary.numbers(vocabulary.codes(batch.column(0)))
            np.add.at(tokens_, number, batch.column(1).to_numpy())
            np.add.at(types, number, 1)
        own = np.arange(len(words), size)
        yield pa.RecordBatch.from_arrays([pa.array(own - len(words)), pa.array(tokens_[own]), pa.array(types[own])], names=["class", "tokens", "types"])

    sums = counted.mapInArrow(tally, "class long, tokens long, types long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    out = np.zeros((2, size - len(words)), np.int64)
    for r in sums.collect():
        out[:, r["class"]] = r["tokens"], r["types"]
    return out[0], out[1]


def _averaged(models: DataFrame, shards: int) -> dict[int, np.ndarray]:
    """The weighted mean of the shards' models, by a tree: no task holds more than some dozen copies of a block."""
    schema = "block int, part int, weight double, parameters binary"
    while True:
        last = shards <= _MERGE
        group = F.lit(0) if last else F.floor(F.col("part") / _MERGE).cast("int")
        models = models.select("block", group.alias("part"), "weight", "parameters", F.col("part").alias("from"))
        models = models.repartition("block", "part").sortWithinPartitions("block", "part", "from").drop("from").mapInArrow(_weighted_means, schema)
        if last:
            return {r["block"]: np.frombuffer(r["parameters"], np.float32) for r in models.collect()}
        shards = -(-shards // _MERGE)


def _learner(shared, side: int, width: int, reach: int, rate: float, chunk: int, most: int = 200_000):
    """Rows (``shard``, ``ids``) come sorted by shard: each shard's tokens train a copy of the shared model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, key, squares = WindowNetwork(side, width, reach), None, None
        held: list[np.ndarray] = []
        size = seen = 0

        def step() -> None:
            nonlocal size
            if size:
                ids = np.concatenate(held).astype(np.int32)
                owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
                network.train(ids, network.around(ids, owner), squares, rate, chunk)
            held.clear()
            size = 0

        def out() -> pa.RecordBatch:
            parts = np.array_split(network.flat, _BLOCKS)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(range(_BLOCKS), pa.int32()), pa.array([key] * _BLOCKS, pa.int32()),
                    pa.array([float(seen)] * _BLOCKS), pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["block", "part", "weight", "parameters"],
            )

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != key:
                    if key is not None:
                        step()
                        yield out()
                    key, seen, squares = shard, 0, np.zeros_like(network.flat)
                    network.flat[:] = shared.value
                own = np.frombuffer(ids.as_buffer(), np.uint16)
                held.append(own)
                size, seen = size + len(own), seen + len(own)
                if size >= most:
                    step()
        if key is not None:
            step()
            yield out()

    return run


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", side: int = 64, width: int = 16, reach: int = 2, classes: int = 512,
    rate: float = 0.3, rounds: int = 4, shard_tokens: int = 2_000_000, least_shards: int = 8,
) -> Fitted:
    """The model of all documents; each of their tokens is a training target once.

    ``side`` is at most 256. Equal rows train alike; words of equal counts at the
    vocabulary's edge are taken in their order.
    """
    spark, size = docs.sparkSession, side * side
    texts = docs.select(F.col(text_col).alias("text"))
    counted = Written(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    found = _frequent(counted.read(), size - classes)
    words = [w for w, _ in found]
    class_tokens, class_types = _class_totals(counted.read(), words, size)
    counted.drop()
    total = sum(n for _, n in found) + int(class_tokens.sum())
    network = WindowNetwork(side, width, reach)
    network.start_at(np.concatenate([[n for _, n in found], class_tokens, np.zeros(size - len(words) - len(class_tokens))]))
    if not total:
        return Fitted(words, network, class_tokens, class_types)

    shards = max(least_shards, -(-total // shard_tokens))
    chunk = int(np.clip(total // (shards * rounds * 32), 128, 4096))  # some 32 steps a shard and round, or more
    vocabulary_words = spark.sparkContext.broadcast(words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(vocabulary_words.value, size)
        for batch in batches:
            for first, counts, codes in _coded(batch.column(1), vocabulary):
                parts = np.split(vocabulary.numbers(codes).astype(np.uint16), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["deal", "ids"])

    deal = F.xxhash64(F.col(id_col), F.col(text_col)).alias("deal")
    dealt = docs.select(deal, F.col(text_col).alias("text")).mapInArrow(number, "deal long, ids binary").where("octet_length(ids) > 0")
    by = {"shard": F.pmod("deal", F.lit(shards)).cast("int"), "round": F.pmod(F.shiftright("deal", 40), F.lit(rounds)).cast("int")}
    rows = Written(dealt.withColumns(by), ("round",))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(network.flat)
        own = rows.read().where(F.col("round") == k).select("shard", "ids", "deal").repartition("shard").sortWithinPartitions("shard", "deal", "ids")
        models = own.select("shard", "ids").mapInArrow(_learner(shared, side, width, reach, rate, chunk), "block int, part int, weight double, parameters binary")
        blocks = _averaged(models, shards)
        if blocks:
            network.flat = np.concatenate([blocks[k] for k in range(_BLOCKS)])
        shared.unpersist()
    rows.drop()
    return Fitted(words, network, class_tokens, class_types)


def score(docs: DataFrame, fitted: Fitted, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``pseudo_log_likelihood``, ``mean_log_probability`` for every document.

    A text without tokens has a likelihood of 0 and a null mean. The words of a
    hash class count as one word here: the documents need not be those of the fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast((fitted.words, fitted.network))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = shared.value
        vocabulary = Vocabulary(words, network.size)
        for batch in batches:
            for first, counts, codes in _coded(batch.column(1), vocabulary):
                ids = vocabulary.numbers(codes)
                owner = np.repeat(np.arange(len(counts)), counts)
                logs = network.log_probability(ids, network.around(ids, owner), rounded=True)
                sums = np.bincount(owner, weights=logs, minlength=len(counts))
                mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), pa.array(sums), mean],
                    names=["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"],
                )

    schema = "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


_WITHIN = pa.schema([("group", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary()), ("rows", pa.binary()), ("documents", pa.binary())])


def _shares(hashes: np.ndarray, tokens_: np.ndarray, types: np.ndarray, prior: float) -> np.ndarray:
    """log P(word | class) for every token of a bucket: its word's count, with ``prior`` added to each word and to one unseen."""
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    own = (hashes % np.uint64(len(tokens_))).astype(np.int64)
    return np.log(counts + prior)[which] - np.log(tokens_ + prior * (types + 1))[own]


def _within(batches: Iterator[pa.RecordBatch], shared, prior: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: the groups' rarer tokens become sums for the groups' documents; the documents' own rows pass."""
    held, key = [], None

    def out() -> pa.RecordBatch:
        groups, hashes, rows = zip(*held, strict=True)
        logs = np.split(_shares(np.concatenate(hashes), *shared.value[2:], prior), np.cumsum([len(h) for h in hashes])[:-1])
        firsts = [np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in rows]
        sums = [np.add.reduceat(own, first).tobytes() for own, first in zip(logs, firsts, strict=True)]
        own = [x[first].tobytes() for x, first in zip(rows, firsts, strict=True)]
        return pa.RecordBatch.from_pydict({"group": groups, "bucket": [key] * len(held), "values": sums, "rows": own, "documents": [None] * len(held)}, _WITHIN)

    for batch in batches:
        for i, number in enumerate(batch.column(1).to_pylist()):
            if number != key:
                if held:
                    yield out()
                held, key = [], number
            if number < 0:
                yield batch.slice(i, 1)
            else:
                group, _, values, rows, _ = (c[i].as_py() for c in batch.columns)
                held.append((group, np.frombuffer(values, np.uint64), np.frombuffer(rows, np.int32)))
    if held:
        yield out()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, its documents' own row first: the documents with the sums of their classes added."""
    documents, total = None, None

    def out() -> pa.RecordBatch:
        counts = documents.column(1).to_numpy()
        mean = pa.array(total / np.maximum(counts, 1), mask=counts == 0)
        return pa.RecordBatch.from_arrays([documents.column(0), documents.column(1), pa.array(total), mean], names=["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"])

    for batch in batches:
        for _, number, values, rows, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number < 0:
                if documents is not None:
                    yield out()
                documents = pa.ipc.open_stream(own).read_next_batch()
                total = documents.column(2).to_numpy().copy()
            else:
                total[np.frombuffer(rows, np.int32)] += np.frombuffer(values, np.float64)
    if documents is not None:
        yield out()


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5, bucket_tokens: int = 500_000, **how) -> DataFrame:
    """Fit on all documents, then score each of them.

    ``doc_id``, ``n_tokens``, ``pseudo_log_likelihood``, ``mean_log_probability``,
    as ``score`` gives them, but each word of a hash class by its own probability
    within the class. Null and empty texts have no tokens; null ids stay null;
    repeated rows are scored each, alike; words of equal counts at the
    vocabulary's edge are taken in their order; other columns are ignored,
    whatever their names; an empty table gives no rows. Texts of any length are
    scored whole, a task holding one text, or 2 MB of them, at a time. Scores do
    not depend on how the rows are partitioned. Rarer words are counted in
    buckets by hash of about ``bucket_tokens`` tokens; a word is never split, and
    one outside a vocabulary of v words has at most 1 / v of all tokens.
    """
    fitted = fit(docs, id_col=id_col, text_col=text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    buckets = max(256, -(-int(fitted.class_tokens.sum()) // bucket_tokens))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network, tokens_, _ = shared.value
        vocabulary, group = Vocabulary(words, network.size), TaskContext.get().partitionId() << 32
        classes = np.uint64(vocabulary.classes)
        for batch in batches:
            for first, counts, codes in _coded(batch.column(1), vocabulary):
                n, owner = len(counts), np.repeat(np.arange(len(counts)), counts)
                rare = np.flatnonzero(codes >= _RARE)
                ids = vocabulary.numbers(codes)
                bucket = (codes[rare] // classes % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
                logs = network.log_probability(ids, network.around(ids, owner), rounded=True)
                own = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(counts.astype(np.int64)), pa.array(np.bincount(owner, weights=logs, minlength=n))],
                    names=["doc_id", "n_tokens", "log"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                by = np.argsort(bucket, kind="stable")
                rare, bucket = rare[by], bucket[by]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                of = bucket[starts].tolist() if len(rare) else []
                hashes, rows = (np.split(x, starts[1:]) if len(rare) else [] for x in (codes[rare], owner[rare].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group] * (len(of) + 1), pa.int64()), pa.array([-1 - group % 4093, *of], pa.int32()),
                        pa.array([None, *(x.tobytes() for x in hashes)], pa.binary()), pa.array([None, *(x.tobytes() for x in rows)], pa.binary()),
                        pa.array([sink.getvalue().to_pybytes(), *[None] * len(of)], pa.binary()),
                    ],
                    schema=_WITHIN,
                )
                group += 1

    schema = "group long, bucket int, values binary, rows binary, documents binary"
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    parts = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _within(batches, shared, prior), schema)
    parts = parts.repartition("group").sortWithinPartitions("group", "bucket")
    return parts.mapInArrow(_added, "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double")
