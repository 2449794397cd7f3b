"""Feature-hash embeddings of text, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Start and multiplier of the two word hashes.
_FIRST = (0x811C9DC5, 0x01000193)
_SECOND = (0x6B8B4567, 0x5BD1E995)
_MASK = 0xFFFFFFFF


def word_slot(word: str, dimensions: int) -> int:
    """The coordinate that a word counts for: two multiplicative hashes of its UTF-16 units, xor-ed."""
    a, b = _FIRST[0], _SECOND[0]
    units = word.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        unit = units[i] | units[i + 1] << 8
        a = (a ^ unit) * _FIRST[1] & _MASK
        b = (b ^ unit) * _SECOND[1] & _MASK
    return (a ^ b) % dimensions


def split_words(text: str) -> list[str]:
    """Lower-cased runs of letters and numbers."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def embed(text: str, dimensions: int = 384) -> list[float]:
    out = np.zeros(dimensions)
    for word in split_words(text):
        out[word_slot(word, dimensions)] += 1
    norm = np.sqrt((out * out).sum())
    return (out / norm if norm else out).tolist()


def feature_hash(text: Column, dimensions: int = 384) -> Column:
    """Word counts hashed to ``dimensions`` coordinates, of length 1; zeros for a text without words, null for null."""
    if dimensions <= 0:
        raise ValueError("dimensions is positive")

    @F.pandas_udf("array<double>")
    def hashed(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(dimensions)
            for w in split_words(t):
                if w not in slots:
                    slots[w] = word_slot(w, dimensions)
                v[slots[w]] += 1
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return hashed(text)
