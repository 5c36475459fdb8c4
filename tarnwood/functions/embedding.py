"""A deterministic stand-in for an embedding provider, for ingestion without a network."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION, MOST_CHARS = 2048, 512


def hashed_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector that depends on the words of a text; an empty text is an error."""
    words = text[:MOST_CHARS].lower().split()
    if not words:
        raise ValueError("empty text cannot be embedded")
    v = np.zeros(dimension)
    for w in words:
        digest = hashlib.sha256(w.encode()).digest()
        for k in range(0, 16, 4):
            v[int.from_bytes(digest[k : k + 4], "little") % dimension] += 1 if digest[16 + k] & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else np.eye(1, dimension)[0]


def embedder(dimension: int = DIMENSION):
    """A column function text -> vector; null for null and blank texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for texts in batches:
            out = []
            for t in texts:
                if t is None or not t.strip():
                    out.append(None)
                    continue
                if t not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[t] = hashed_vector(t, dimension).astype(np.float32)
                out.append(known[t])
            yield pd.Series(out)

    return embed
