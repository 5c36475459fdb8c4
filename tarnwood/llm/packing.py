"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each document goes to the fill level whose choice leaves the smallest sum of
squared counts of partially filled windows (Csirik, Johnson, Kenyon, Orlin,
Shor and Weber, "On the sum-of-squares algorithm for bin packing"). The counts
live in a level array of ``window`` entries, so a placement costs one pass over
the levels and no search over windows.

Every scan partition packs its own rows: no shuffle, and an executor's loss
repeats only its partitions. At a partition's end some windows are still open.
As many of them, the fullest, as are needed to hold all open pieces stay as they
were placed; the others are taken apart, and their pieces fill the gaps, cut
where they must be. So a partition pads less than one window, and its open
windows hold no more than its own ids, whatever its size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, blocks, resident

#: A blank goes with the word after it; runs of white space end before that blank. The
#: byte-level pre-tokenizer never joins across these borders.
_PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_CACHED_CHARS = 64
#: Marks that end a word's run of letters or digits.
_STOPS = frozenset(".,;:!?")


#: Beyond the Latin blocks, where regex engines agree on what a letter is.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _merges_of(tokenizer):
    """An encoder of single pieces by the tokenizer's own vocabulary, or None without tiktoken."""
    try:
        import tiktoken
    except ImportError:
        return None
    from public_tokenizers import PATTERN

    letters = _byte_letters()
    ranks = {bytes(map(letters.__getitem__, k)): i for k, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class PieceCoder(dict):
    """Piece of text -> its token ids as little-endian uint32 bytes, filled by the tokenizer on demand.

    Pieces of Latin script go through the byte-pair merges of tiktoken, given the
    same vocabulary: the ids are those of the tokenizers library, several times
    faster for words not met before. Other pieces, and all where tiktoken is
    missing, go through the library itself. Two generations of at most ``capacity`` pieces: when the young one is full it
    becomes the old one, so pieces in use stay and the rest goes.
    """

    def __init__(self, path: str, capacity: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity, self.old = capacity, {}
        self.fast = _merges_of(self.tokenizer)
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = {s: struct.pack("<I", i) for s, i in specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece[-1] in _STOPS and piece[-2:-1].isascii() and piece[-2:-1].isalnum():
                ids = self[piece[:-1]] + self[piece[-1]]  # the pre-tokenizer cuts between the two
            else:
                if self.fast and (piece.isascii() or max(piece) < _LATIN_END):
                    found = self.fast(piece)
                else:
                    found = self.tokenizer.encode(piece, None, False, False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= _CACHED_CHARS:
            if len(self) >= self.capacity:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; special strings in it are single tokens, the library's default."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]
        out = []
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for block in blocks(part):
                    out.extend(map(self.__getitem__, _PIECE.findall(block)))
        return b"".join(out)


def coder(path: str) -> PieceCoder:
    """The worker's coder for a vocabulary file."""
    return resident(("pieces", path), lambda: PieceCoder(path))


class SumOfSquares:
    """Open windows by fill level, and the pieces that each holds."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # counts[0] and counts[window] stay 0
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level that minimises the sum of squares after placing ``size``; ties go to the fuller window."""
        room = self.window - size
        levels = np.flatnonzero(self.counts[: room + 1])
        after = self.counts[size : self.window + 1]
        fresh = 2 * self.counts[size] + 1 if size < self.window else 0
        if not levels.size:
            return 0
        change = 2 * (after[levels] - self.counts[levels]) + 2
        if levels[-1] == room:
            change[-1] = 1 - 2 * self.counts[room]
        best = levels.size - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= fresh else 0

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of ``size`` tokens away; a window that this fills is returned."""
        level = self.level_for(size)
        if level:
            bins = self.open[level]
            content = bins.pop()
            self.counts[level] -= 1
            if not bins:
                del self.open[level]
        else:
            content = []
        content.append(piece)
        level += size
        if level == self.window:
            return content
        self.open.setdefault(level, []).append(content)
        self.counts[level] += 1
        return None

    def finish(self) -> list[list]:
        """The contents of all open windows with their gaps filled, which are closed.

        Pieces are (document, start, ids as 4 bytes each, total). The emptiest
        windows are taken apart, their pieces go into the others' gaps, the largest
        gaps first, and are cut where a gap ends. Only the last windows can have a
        gap left, less than a window in all.
        """
        levels = [(level, content) for level in sorted(self.open, reverse=True) for content in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        stay = -(-sum(level for level, _ in levels) // self.window)
        loose = [p for _, content in levels[stay:] for p in content]
        loose.sort(key=lambda p: len(p[2]))
        for level, content in reversed(levels[:stay]):
            gap = self.window - level
            while gap and loose:
                doc, start, ids, total = loose.pop()
                take = min(gap, len(ids) // 4)
                content.append((doc, start, ids[: 4 * take], total))
                gap -= take
                if len(ids) > 4 * take:
                    loose.append((doc, start + take, ids[4 * take :], total))
        return [content for _, content in levels[:stay]]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)


def _packer(path: str, window: int, eos: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        levels, base = SumOfSquares(window), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        made = size = 0

        def close(content: list) -> None:
            nonlocal made, size
            offset = 0
            for doc, start, ids, total in content:
                n = len(ids) // 4
                rows.append((doc, start, n, total, base + made, offset, ids))
                offset += n
                size += len(ids) + 64
            made += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)
            rows.clear()
            size = 0
            return batch

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, doc in enumerate(docs):
                ids = code.encode(texts[k].as_py() or "") + eos
                total, start = len(ids) // 4, 0
                while total - start >= window:
                    close([(doc, start, ids[4 * start : 4 * (start + window)], total)])
                    start += window
                if start < total:
                    full = levels.place((doc, start, ids[4 * start :], total), total - start)
                    if full:
                        close(full)
                if size > 4 << 20:
                    yield flush()
        for content in levels.finish():
            close(content)
            if size > 4 << 20:
                yield flush()
        if rows:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    window: int = 2048, eos_id: int = 1,
) -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens, one output row per piece.

    Columns: ``doc_id``, ``start`` (tokens of the document before the piece),
    ``length``, ``doc_tokens`` (with the closing ``eos_id``), ``sequence_id``
    (scan partition and running number), ``offset`` in the sequence, ``ids``
    (little-endian uint32 bytes). A null or empty text is the closing token
    alone; a null id stays null; repeated rows are packed each; other columns
    are ignored, whatever their names; an empty table gives no rows. Texts of any
    length are packed whole; full windows are cut from a long one first, and its
    rest is placed. Of levels that are equally good the fullest is taken.
    """
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in _OUT.names[:-1]] + [T.StructField("ids", T.BinaryType())]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, window, np.uint32(eos_id).tobytes()), schema)
