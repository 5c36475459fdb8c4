"""Word shingles as 64-bit numbers, and circulant MinHash signatures over them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .common import ASCII_WORD, lower_ascii

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """Word -> 64-bit hash, kept while there is room."""

    def __init__(self, capacity: int = 300_000):
        self.capacity = capacity

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.capacity:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text; of fewer words, all of them as one."""
    words = ASCII_WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(width, len(words))):
            out = (out ^ h[j : j + n]) * _A
            out ^= out >> _S32
            out *= _B
            out ^= out >> _S29
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


#: Two permutations of the 32-bit numbers: multipliers, and the shift between them.
_FIRST = (np.uint32(0x85EBCA6B), np.uint32(13), np.uint32(0xC2B2AE35))
_SECOND = (np.uint32(0x7FEB352D), np.uint32(15), np.uint32(0x846CA68B))


def _permuted(x: np.ndarray, by: tuple[np.uint32, np.uint32, np.uint32]) -> np.ndarray:
    """One of the fixed permutations of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= by[0]
    x ^= x >> by[1]
    x *= by[2]
    x ^= x >> np.uint32(16)
    return x


class CirculantMinHash:
    """Signatures from two permutations (Li and Li, "C-MinHash", 2021).

    The first permutation breaks up the structure of the set once; the second,
    shifted circularly by 0 .. size-1 places, gives all the coordinates. Both act
    on the 32-bit numbers and are computed, so there is no table to ship.
    """

    def __init__(self, bands: int, rows: int, chunk: int = 2048):
        self.bands, self.rows, self.chunk = bands, rows, chunk
        self.shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * _A

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """One uint32 for each shift; of an empty set, the largest number."""
        first = _permuted((shingles ^ (shingles >> _S32)).astype(np.uint32), _FIRST)
        best = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(first), self.chunk):
            np.minimum(best, _permuted(first[at : at + self.chunk] - self.shifts, _SECOND).min(axis=1), out=best)
        return best

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, its number included."""
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        with np.errstate(over="ignore"):
            for j in range(self.rows):
                key = (key ^ parts[:, j]) * _B
                key ^= key >> _S29
                key *= _A
                key ^= key >> _S32
        return key.view(np.int64)
