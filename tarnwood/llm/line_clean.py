"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much are rejected.

The line rules follow the published web-corpus filters (C4: Raffel et al., 2020;
Gopher: Rae et al., 2021): symbol noise, navigation bars, boilerplate notices,
repeated lines, and shouting.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORD, by_batch

_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTER = re.compile(r"[^\W\d_]")
#: Notices that stand on lines of their own.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "cookie policy", "enable javascript", "privacy policy",
    "sign up for our newsletter", "subscribe to our newsletter", "terms of service", "terms of use",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_BAR = re.compile(r"\s[|>»•·/]\s")


class LineRules:
    """Which lines of a text fail, and why. Thresholds are parameters.

    symbols: as many symbol characters as ``max_symbols`` a word; navigation:
    ``min_bars`` separators or more, at least one for each two words;
    boilerplate: a known notice in a line of at most ``notice_words`` words;
    repeated: equal to an earlier line of the text; shouting: ``min_shout``
    words or more and over ``max_upper`` of the letters upper case; punctuation:
    ``min_open`` words or more without any mark that ends or divides a sentence.
    """

    def __init__(self, max_symbols=0.3, min_bars=2, notice_words=30, min_shout=4, max_upper=0.7, min_open=10):
        self.max_symbols, self.min_bars, self.notice_words = max_symbols, min_bars, notice_words
        self.min_shout, self.max_upper, self.min_open = min_shout, max_upper, min_open

    def failure(self, line: str, words: list[str], repeated: bool) -> str | None:
        """The first rule that a line with words fails."""
        n = len(words)
        if repeated:
            return "repeated"
        if len(_SYMBOL.findall(line)) >= self.max_symbols * n + 1:
            return "symbols"
        bars = len(_BAR.findall(line))
        if bars >= self.min_bars and 2 * bars >= n // 2:
            return "navigation"
        if n <= self.notice_words and _BOILERPLATE.search(line):
            return "boilerplate"
        if n >= self.min_shout and not line.islower():
            upper = sum(map(str.isupper, line))
            if upper and upper > self.max_upper * len(_LETTER.findall(line)):
                return "shouting"
        if n >= self.min_open and not re.search(r"[.!?,;:。！？]", line):
            return "punctuation"
        return None


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more.

    Windows are named exactly, by ranks of pairs, pairs of pairs and so on; no
    hashing, and memory is a few numbers a word.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    name, _ = pd.factorize(np.array(words, object))
    name = name.astype(np.int64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)

    power, size = name, 1
    whole, have = None, 0
    bits = width
    while bits:
        if bits & 1:
            part = power[have : have + n]
            whole = part if whole is None else joined(whole, part)
            have += size
        bits >>= 1
        if bits:
            power = joined(power[:-size], power[size:])
            size *= 2
    twice = np.bincount(whole)[whole] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str, rules: LineRules, max_lost: float) -> tuple:
    """The figures, the verdict and the cleaned text of one document."""
    words = ASCII_WORD.findall(text)
    seen: set[str] = set()
    kept_lines, lost, duplicates = [], 0, 0
    for line in text.split("\n"):
        own = ASCII_WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        repeated = line in seen
        duplicates += repeated
        seen.add(line)
        if rules.failure(line, own, repeated):
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
    chars, repeats = sum(map(len, words)), repeated_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    kept = not failed and lost <= max_lost * chars
    return len(words), chars, len(_SYMBOL.findall(text)), duplicates, repeats, failed, lost, kept, "\n".join(kept_lines)


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, max_lost: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id``, the figures, ``lost_chars``, ``kept`` and ``clean_text``.

    A document is kept unless it has under ten words, over a fifth of its words
    repeat in 5-word windows, or its failing lines hold more than ``max_lost``
    of its word characters. Null and empty texts have no words and are not kept;
    their ``clean_text`` is empty. A line that equals an earlier one fails, the
    first of them stays. Null ids stay null; repeated rows are judged each, alike;
    other columns are ignored, whatever their names; an empty table gives no rows.
    Texts of any length are judged whole, in memory of some 100 bytes a word.
    Narrow: no shuffle.
    """
    rules = rules or LineRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        rows = [judge(texts[i].as_py() or "", rules, max_lost) for i in range(len(texts))]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, lost_chars long, kept boolean, clean_text string"
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(work), schema)
