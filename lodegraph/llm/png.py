"""Media columns: lossless PNG in binary columns, and cosine-transform hashes of what they show.

Writer and reader handle 8-bit grey PNG: chunks with CRC tests, zlib data
split over several IDAT chunks, and all five row filters undone with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(image: np.ndarray, level: int = 1, idat: int = 1 << 16, filters: tuple[int, ...] = (NONE, SUB, UP)) -> bytes:
    """An 8-bit grey PNG of a 2-D uint8 array; all rows take that one of ``filters`` whose result has the least sum of magnitudes."""
    height, width = image.shape
    best = None
    for kind in filters:
        rows = image.copy()
        if kind == SUB:
            rows[:, 1:] -= image[:, :-1]
        elif kind == UP:
            rows[1:] -= image[:-1]
        elif kind in (AVERAGE, PAETH):
            left, above, corner = (np.zeros_like(image) for _ in range(3))
            left[:, 1:], above[1:], corner[1:, 1:] = image[:, :-1], image[:-1], image[:-1, :-1]
            rows -= ((left.astype(np.uint16) + above) // 2).astype(np.uint8) if kind == AVERAGE else _paeth(left, above, corner)
        cost = int(np.minimum(rows, -rows).sum(dtype=np.int64)) if len(filters) > 1 else 0
        if best is None or cost < best[0]:
            best = cost, kind, rows
    _, kind, rows = best
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, rows
    data = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", data[i : i + idat]) for i in range(0, len(data), idat)), _chunk(b"IEND", b"")])


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y, z = (v.astype(np.int16) for v in (a, b, c))
    p = x + y - z
    pa_, pb, pc = abs(p - x), abs(p - y), abs(p - z)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG that isn't interlaced; ValueError if it is damaged or of another kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise ValueError("cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of IHDR")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise ValueError(f"chunk {kind!r} is not known")
    if head is None or not ended:
        raise ValueError("cut off")
    width, height, depth, colour, method, filtering, interlace = head
    if (depth, colour, method, filtering, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG without interlace")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:].copy())


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters in place; runs of rows of one kind go together where the filter allows it."""
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("filter is not known")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]]) if len(kinds) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        kind, part = kinds[a], rows[a:b]
        if kind == SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == UP:
            if a:
                part[0] += rows[a - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (AVERAGE, PAETH):
            for i in range(a, b):
                above = rows[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
                left = corner = 0
                row, up = rows[i].tolist(), above.tolist()
                for j, v in enumerate(row):
                    if kind == AVERAGE:
                        left = (v + (left + up[j]) // 2) & 255
                    else:
                        p = left + up[j] - corner
                        da, db, dc = abs(p - left), abs(p - up[j]), abs(p - corner)
                        left = (v + (left if da <= db and da <= dc else up[j] if db <= dc else corner)) & 255
                        corner = up[j]
                    row[j] = left
                rows[i] = row
    return rows


@cache
def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


def _shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged by area to ``n``."""
    edges = np.linspace(0, len(x), n + 1)
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)])
    whole = np.minimum(edges.astype(int), len(x) - 1)
    at = total[whole] + (edges - whole)[:, None] * x[whole]
    return np.diff(at, axis=0) * (n / len(x))


def cosine_hash(image: np.ndarray, size: int = 32, low: int = 8) -> bytes:
    """``low`` x ``low`` bits: which of the lowest frequencies of the image, shrunk to ``size`` x ``size``, exceed their median."""
    small = _shrunk(_shrunk(image, size).T, size).T
    c = _cosines(size, low)
    wave = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(wave > np.median(wave[1:])).tobytes()


def as_image(text: str | None, width: int = 64) -> tuple[np.ndarray, int]:
    """A text's UTF-8, zero-padded to a positive multiple of ``width``, as rows of samples; and its length before."""
    body = (text or "").encode()
    rows = max(1, -(-len(body) // width))
    return np.frombuffer(body.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width), len(body)


def with_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, media)``: each text as PNG; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                found = [as_image(x.as_py(), width) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([write_png(image) for image, _ in found], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` -> digests of the samples read back and of the PNG, and the hash as hexadecimal.

    A null or damaged image raises ValueError and so fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                data = x.as_py()
                if data is None:
                    raise ValueError("no image")
                image = read_png(data)
                body = image.tobytes()
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image).hex()))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
