"""Words, shingles and their 64-bit hashes over Arrow string columns, vectorised.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z are
lower-cased.  Those bytes never occur inside a multi-byte UTF-8 character, so
working on bytes equals working on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text worked on at once; a single longer text is worked on whole.
CHUNK_BYTES = 1 << 19

#: From this many bytes on a word is hashed by BLAKE2b: a polynomial modulo 2**64 has words of 1,024 letters that meet for certain.
LONG_WORD = 256


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words(NamedTuple):
    hashes: np.ndarray  #: one a word, in order
    starts: np.ndarray  #: byte offsets into the bytes given
    ends: np.ndarray
    bounds: np.ndarray  #: words of text i are bounds[i]:bounds[i + 1]


def words(flat: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(flat)
    low = _LOWER[flat]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    power, inverse = _power(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the texts' bounds; a text of fewer words has its whole sequence as one."""
    count = np.diff(w.bounds)
    many = np.maximum(count - k + 1, 0)
    short = (count > 0) & (many == 0)
    size = many + short
    bounds = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(w.bounds[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(count, k), size)
    out = length.astype(np.uint64)
    for i in range(k):
        on = length > i
        out[on] = mix(out[on] * _M + w.hashes[first[on] + i])
    return out, bounds
