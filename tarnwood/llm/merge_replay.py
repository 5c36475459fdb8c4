"""Byte-level byte-pair encoding by corpus-level merge replay, and decoding.

The distinct words of a run of documents are laid end to end as byte tokens. An
inverted index leads from the token that a pair makes to the places where such
pairs stand; merges are taken from it in the order of their rank and applied at
all their places at once, and only the two neighbours of a merged pair are
looked at anew. Each distinct word is so merged once, however often it occurs,
and a document's ids are those of its words in a row.

Narrow: each task replays the words of its own documents, some megabytes of text
at a time, and keeps the ids of words it has met in a cache of bounded size. A
dictionary of all words of the corpus would have to be joined with every
occurrence; nothing is shuffled here.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, blocks, carried, ddl, resident

#: Letters and numbers below U+0250.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_END = "\u0250"
#: The public pattern for texts below U+0250; other texts are matched with each later character replaced by one of its kind.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{WHITE}{_LETTERS}{_NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_CACHED_CHARS = 64
#: Words of more bytes are merged one by one.
_LONG_WORD = 256
#: Characters of text whose words are replayed together, and bytes of ids in one output batch.
_RUN = 2 << 20
_OUT = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is its id, from a rank file: a base64 token and a number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Kinds(dict):
    """Code point -> ``a`` for a letter, ``1`` for a number, ``!`` for others, as the tiktoken library's pattern takes it.

    Libraries follow different versions of Unicode, so the library is asked: with
    two merges over a border, it shows whether its pattern cuts there. What is below
    U+0250, and white space, stays as it is.
    """

    def __init__(self):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {bytes([b]): b for b in range(256)}
        for head in b"a1":
            for lead in range(128, 256):
                ranks[bytes([head, lead])] = len(ranks)
        self._encode = tiktoken.Encoding("kinds", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.update({c: chr(c) for c in range(ord(_LATIN_END))})
        self.update({c: chr(c) for c in map(ord, re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))})

    def __missing__(self, code: int) -> str:
        kind = "!"
        for head in "a1":
            if self._encode(head + chr(code))[0] >= 256:
                kind = head
        self[code] = kind
        return kind


def _distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


class MergeReplay:
    """Encodes many words at once by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.top = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}  # (left, right) -> the token that they make
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.top + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each two make; ``top`` where there is none."""
        key = left * self.top + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.top)

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of one long word, by a heap of its pairs."""
        if word in self.ranks:
            return np.array([self.ranks[word]])
        ranks, text, n = self.ranks, self.bytes_of, len(word)
        token, after, before = self.byte[np.frombuffer(word, np.uint8)].tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        made = [ranks.get(word[i : i + 2], -1) for i in range(n)]
        made[-1] = -1
        heap = [(r, i) for i, r in enumerate(made) if r >= 0]
        heapify(heap)
        while heap:
            rank, p = heappop(heap)
            if made[p] != rank:
                continue
            q = after[p]
            token[p], made[q], after[p] = rank, -1, after[q]
            if after[p] >= 0:
                before[after[p]] = p
            for place in (p, before[p]):
                if place >= 0:
                    made[place] = ranks.get(text[token[place]] + text[token[after[place]]], -1) if after[place] >= 0 else -1
                    if made[place] >= 0:
                        heappush(heap, (made[place], place))
        ids, p = [], 0
        while p >= 0:
            ids.append(token[p])
            p = after[p]
        return np.array(ids)

    def encode(self, words: list[bytes], band: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each word's end: of a word's pairs the one of lowest rank is merged first, the leftmost of equals.

        The index holds the places of pairs by bands of ``band`` ranks, taken in
        order. Within a band, every word that has such a pair merges its first
        one, again and again, until no word has any; a pair that comes up with a
        lower rank than the band's is merged before others of its word, as its
        turn would be. A word that is a token as a whole is that token.
        """
        apart = {k: self._long(w) for k, w in enumerate(words) if len(w) > _LONG_WORD}
        if apart:
            ids, ends = self.encode([b"" if k in apart else w for k, w in enumerate(words)], band)
            parts, lengths = np.split(ids, ends[:-1]), np.diff(ends, prepend=0)
            for k, found in apart.items():
                parts[k], lengths[k] = found, len(found)
            return np.concatenate(parts), np.cumsum(lengths)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n, top = len(token), self.top
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        made = np.full(n + 1, top)  # what a place and the one after it make; the last place stands for none
        inner = np.nonzero(after >= 0)[0]
        made[inner] = self._pair(token[inner], token[inner + 1])
        whole = {k: r for k, w in enumerate(words) if len(w) > 1 and (r := self.ranks.get(w)) is not None}
        index: list[list[np.ndarray]] = [[] for _ in range(top // band + 1)]

        def note(places: np.ndarray) -> None:
            bands = made[places] // band
            order = np.argsort(bands, kind="stable")
            places, bands = places[order], bands[order]
            cuts = np.nonzero(np.diff(bands))[0] + 1
            for b, part in zip(bands[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                index[b].append(part)

        if whole:
            made[np.nonzero(np.isin(word, np.fromiter(whole, np.int64, len(whole))))[0]] = top
        start = np.nonzero(made[:n] < top)[0]
        if len(start):
            note(start)
        gone = np.zeros(n, bool)
        for b in range(len(index)):
            if not index[b]:
                continue
            high = min((b + 1) * band, top)
            open_ = _distinct(np.concatenate(index[b]))
            index[b] = []
            while len(open_ := open_[made[open_] < high]):
                order = np.lexsort((open_, made[open_], word[open_]))
                open_ = open_[order]
                first = np.ones(len(open_), bool)
                first[1:] = word[open_[1:]] != word[open_[:-1]]
                p = open_[first]
                q = after[p]
                end, left = after[q], before[p]
                token[p], after[p], gone[q], made[q] = made[p], end, True, top
                has_end, has_left = end >= 0, left >= 0
                before[end[has_end]] = p[has_end]
                made[p] = top
                made[p[has_end]] = self._pair(token[p[has_end]], token[end[has_end]])
                made[left[has_left]] = self._pair(token[left[has_left]], token[p[has_left]])
                touched = np.concatenate([p[has_end], left[has_left]])
                fresh = made[touched]
                later = touched[(fresh >= high) & (fresh < top)]
                if len(later):
                    note(later)
                open_ = _distinct(np.concatenate([open_, touched[fresh < high]]))
        kept = ~gone
        for k, rank in whole.items():
            kept[ends[k] - sizes[k] + 1 : ends[k]] = False
            token[ends[k] - sizes[k]] = rank
        return token[kept], np.concatenate([[0], np.cumsum(kept)])[ends]


class Encoder:
    """Texts to ids; what it has met stays in two generations of at most ``capacity`` words each."""

    def __init__(self, path: str, capacity: int = 300_000):
        self.replay = MergeReplay(read_ranks(path))
        self.kinds, self.capacity = Kinds(), capacity
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The matches of the public pattern."""
        if text.isascii() or max(text) < _LATIN_END:
            return _PIECE.findall(text)
        return [text[m.start() : m.end()] for m in _PIECE.finditer(text.translate(self.kinds))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian uint32 bytes; the new words of all of them are one replay."""
        cut = [self.pieces(t) for t in texts]
        met: set[str] = set().union(*cut)
        unknown = met.difference(self.known)
        fresh = {w: self.old[w] for w in unknown if w in self.old}
        new = [w for w in unknown if w not in self.old]
        ids, ends = self.replay.encode([w.encode() for w in new])
        flat, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        fresh.update(zip(new, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        if len(self.known) + len(fresh) > self.capacity:
            fresh |= {w: self.known[w] for w in met if w in self.known}
            self.old, self.known = self.known, {}
        self.known |= fresh
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for word in new:
            if len(word) > _CACHED_CHARS:
                del self.known[word]
        return out


def _runs(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Texts and the rows that they belong to, some megabytes at a time; a longer text comes in several pieces."""
    rows, parts, size = [], [], 0
    for k in range(len(texts)):
        for part in blocks(texts[k].as_py() or ""):
            rows.append(k)
            parts.append(part)
            size += len(part)
            if size >= _RUN:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _decoded(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, carry: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` (little-endian uint32 bytes), and with ``decode`` ``decoded``, the bytes of the ids.

    Ids are those that the tiktoken library gives with the public pattern and no
    special tokens; strings like those of special tokens are ordinary text. A null
    or empty text has no ids; a null id stays null; repeated rows are encoded
    each; other columns are ignored, whatever their names, but with ``carry`` the
    whole input row comes along as a struct of that name; an empty table gives no
    rows. Texts of any length are encoded whole; of a text over a mebibyte,
    pieces cut before a blank between two words are worked through in turn, and
    a word of any length is one. Of equal ranks in a word the leftmost goes first.
    """
    along, more = carried(docs, carry)
    plain = ddl("doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = resident(("replay", ranks_path), lambda: Encoder(ranks_path))

        def out(batch: pa.RecordBatch, first: int, made: list[bytes]) -> pa.RecordBatch:
            part = batch.slice(first, len(made))
            columns = [part.column(0), pa.array([len(i) // 4 for i in made], pa.int64()), pa.array(made, pa.binary())]
            if decode:
                columns.append(pa.array([_decoded(ids, code.replay.bytes_of) for ids in made], pa.binary()))
            return pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*plain.names, *more.names])

        for batch in batches:
            done, open_, size = 0, [], 0  # rows given out, ids of the rows after them, their bytes
            for rows, parts in _runs(batch.column(1)):
                for k, ids in zip(rows, code.encode(parts), strict=True):
                    if done + len(open_) <= k:
                        if size >= _OUT:
                            yield out(batch, done, [b"".join(x) for x in open_])
                            done, open_, size = done + len(open_), [], 0
                        open_.append([])
                    open_[-1].append(ids)
                    size += len(ids)
            if open_:
                yield out(batch, done, [b"".join(x) for x in open_])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *along)
    return rows.mapInArrow(run, T.StructType(plain.fields + more.fields))


def decode_documents(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with ``to``: the bytes that the ids of ``ids_col`` stand for; null stays null, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = resident(("bytes", ranks_path), lambda: {i: t for t, i in read_ranks(ranks_path).items()})
        for batch in batches:
            at, column, first, texts, size = batch.schema.get_field_index("_ids"), None, 0, [], 0
            column = batch.column(at)
            for k in range(batch.num_rows):
                ids = column[k].as_py()
                texts.append(None if ids is None else _decoded(ids, table))
                size += len(texts[-1] or b"")
                if size >= _OUT or k == batch.num_rows - 1:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.binary())], names=[*batch.schema.names[:at], to])
                    first, texts, size = k + 1, [], 0

    kept = [c for c in encoded.columns if c != to]
    schema = T.StructType([*encoded.select(*[encoded[c] for c in kept]).schema.fields, T.StructField(to, T.BinaryType())])
    return encoded.select(*[encoded[c] for c in kept], encoded[ids_col].alias("_ids")).mapInArrow(run, schema)
