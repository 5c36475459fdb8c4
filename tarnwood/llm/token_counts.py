"""Exact token counts by a compiled finite-state transducer.

A byte-pair encoder is a finite-state device: the encoding of a prefix is known
from its last token, and a token may follow another exactly if merging the two
alone gives the pair back (Berglund and van der Merwe, "Formalizing BPE
tokenization", 2023). ``BpeTransducer`` builds its states on demand and numbers them. Every transition is annotated with the tokens it emits, which may be
negative where a longer token swallows earlier ones; a word's count is the sum
along its path. Paths of whole words are kept as single arcs.

A text is cut into chunks. A chunk's state map sends "a word left open" to "a
word left open" and a count; it is held as (head, count, tail), where head and
tail are what stands before the first and after the last white space. Such maps
compose associatively, so a chunk needs nothing from its neighbours and the
chunks of a text are combined by a prefix scan.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, by_batch, resident

_SPACE = re.compile(f"[{WHITE}]")
_WORDS = re.compile(f"[^{WHITE}]+")
_CHUNK = 1 << 16
_CACHED_CHARS = 48


class BpeTransducer:
    """Counts the tokens of one pre-token, given as symbols, along annotated transitions.

    A state is (letters, bounds): the longest suffix of what was read that some
    token may still continue, and for the border before each of its letters, and
    after the last, the last token of the prefix ending there (None at the
    start) and its count relative to the newest border.
    """

    START = ("", ((None, 0),))

    def __init__(self, merges: list[tuple[str, str]], suffix: str, capacity: int = 200_000):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.suffix, self.capacity = suffix, capacity
        self.tokens = {a + b for a, b in merges}
        bodies = {t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t in self.tokens}
        self.prefixes = {b[:i] for b in bodies for i in range(1, len(b) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the compiled states; they are compiled again when met."""
        self.numbers: dict[tuple, int] = {self.START: 0}
        self.states: list[tuple] = [self.START]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix] if body else [token]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """The byte-pair encoding by its definition; used on pairs of tokens only."""
        parts = list(parts)
        none = len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            a, b = parts[i], parts[i + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stands(self, token: str) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merge(self.symbols(token)) == [token]
        return self.alone[token]

    def follows(self, before: str, token: str) -> bool:
        """Whether the encoding of the two strings together is the two tokens."""
        key = (before, token)
        if key not in self.pairs:
            if len(self.pairs) >= self.capacity:
                self.pairs.clear()
            self.pairs[key] = self.merge(self.symbols(before) + self.symbols(token)) == [before, token]
        return self.pairs[key]

    def last_token(self, letters: str, bounds: tuple, symbol: str) -> tuple[str, int]:
        """The last token once ``symbol`` is read, and the count then."""
        for i in range(len(letters) + 1):
            token = letters[i:] + symbol
            if i < len(letters) and token not in self.tokens or not self.stands(token):
                continue
            before, count = bounds[i]
            if before is None or self.follows(before, token):
                return token, count + 1
        raise ValueError(f"no token ends in {symbol!r}")

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """Add the transition from ``state`` on ``symbol``: the next state and the tokens it emits."""
        letters, bounds = self.states[state]
        token, emitted = self.last_token(letters, bounds, symbol)
        letters, bounds = letters + symbol, (*bounds, (token, emitted))
        skip = next((i for i in range(len(letters)) if letters[i:] in self.prefixes), len(letters))
        target = (letters[skip:], tuple((t, c - emitted) for t, c in bounds[skip:]))
        number = self.numbers.setdefault(target, len(self.states))
        if number == len(self.states):
            self.states.append(target)
            self.arcs.append({})
        self.arcs[state][symbol] = arc = (number, emitted)
        return arc

    def count(self, letters: str) -> int:
        """Tokens of a pre-token of plain symbols; the last one carries the word's end."""
        if len(self.states) > self.capacity:
            self.forget()
        state = total = 0
        for symbol in letters[:-1]:
            state, emitted = self.arcs[state].get(symbol) or self.compile(state, symbol)
            total += emitted
        end = letters[-1] + self.suffix
        known = self.arcs[state].get(end)
        if known is None:
            known = self.arcs[state][end] = (0, self.last_token(*self.states[state], end)[1])
        return total + known[1]


class StateMap(NamedTuple):
    """What a chunk does: the open words at its ends and the tokens between; ``tail`` is None without white space."""

    head: str
    tokens: int
    tail: str | None


class CountingTokenizer:
    """Token counts of whole texts for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, capacity: int = 400_000):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = BpeTransducer(merges, model.get("end_of_word_suffix") or "")
        specials = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.words: dict[str, int] = {}
        self.capacity = capacity
        self.simple = self.ascii_rule(path)

    @staticmethod
    def ascii_rule(path: str) -> re.Pattern | None:
        """The pre-token pattern for plain ASCII, if the file's steps are the ones that this shortcut knows."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or not cuts[0]["invert"]:
            return None
        pattern = cuts[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace("[\\p{N}]", "[0-9]").replace(r"\p{N}", "0-9")
        return None if "\\p" in pattern else re.compile(pattern, re.ASCII)

    def plain(self, word: str) -> int:
        if self.simple and word.isascii() and word.isprintable():  # its bytes stand for themselves
            return sum(map(self.bpe.count, self.simple.findall(word.lower())))
        text = self.normalizer.normalize_str(word) if self.normalizer else word
        return sum(self.bpe.count(piece) for piece, _ in self.pre.pre_tokenize_str(text) if piece)

    def word(self, word: str) -> int:
        """Tokens of a string without white space; special strings in it count one."""
        known = self.words.get(word)
        if known is None:
            if self.special and "<" in word and self.special.search(word):
                known = sum(self.plain(p) for p in self.special.split(word) if p) + len(self.special.findall(word))
            else:
                known = self.plain(word)
            if len(word) <= _CACHED_CHARS:
                if len(self.words) >= self.capacity:
                    self.words.clear()
                self.words[word] = known
        return known

    def chunk(self, text: str) -> StateMap:
        """The state map of one chunk."""
        first = _SPACE.search(text)
        if first is None:
            return StateMap(text, 0, None)
        words = _WORDS.findall(text, first.start())
        tail = words.pop() if words and not _SPACE.match(text[-1]) else ""
        get, total = self.words.get, 0
        for w in words:
            n = get(w)
            total += self.word(w) if n is None else n
        return StateMap(text[: first.start()], total, tail)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; associative."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        joined = a.tail + b.head
        return StateMap(a.head, a.tokens + b.tokens + (self.word(joined) if joined else 0), b.tail)

    def count(self, text: str, size: int = _CHUNK) -> int:
        """Tokens of a whole text: the chunks' maps, composed pairwise in rounds."""
        maps = [self.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + maps[len(paired) * 2 :]
        if not maps:
            return 0
        ends = (maps[0].head, maps[0].tail or "")
        return maps[0].tokens + sum(self.word(w) for w in ends if w)


def counter(path: str) -> CountingTokenizer:
    """The worker's transducer for a vocabulary file."""
    return resident(("counts", path), lambda: CountingTokenizer(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    A null or empty text has no bytes and no tokens; a null id stays null;
    repeated rows give repeated results; other columns are ignored, whatever
    their names; an empty table gives no rows. Narrow: no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, count = batch.column(2), counter(tokenizer_path).count
        tokens = [count(texts[i].as_py() or "") for i in range(len(texts))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(by_batch(work), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
