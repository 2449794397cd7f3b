"""Benchmark decontamination: CGK walks, bit-sampling LSH over windows, exact edit verification.

Chakraborty, Goldenberg and Koucky's embedding walks a string and at each step
stays or goes on by one random bit of (step, byte); two strings walked by the
same bits fall back into step after an edit, so a small edit distance becomes
a small Hamming distance.  A table samples coordinates of one such walk.  They
are the walk's first ones: with an edit in every fifth byte two walks part for
longer and longer.  An item therefore enters with the walk from each of its
offsets, and the text with that from every ``stride`` th byte, so that an
occurrence is tried at many places, each by all tables.  How many tables the
target recall takes is measured on the items themselves, changed as much as the
threshold allows.  Where coordinates meet, Myers' bit-vector search decides
over the 64 bytes around and then over the whole item.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm.scratch import bounded_batches
from lodegraph.llm.words import mix, utf8

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 0x20
_U = np.uint64
#: Walks see a byte as one of 16 kinds, so that four bytes index a table of four steps; coordinates are whole bytes.
_KIND = (mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) & _U(15)).astype(np.uint16)
_SPACE = 64


@dataclass(frozen=True)
class Leaks:
    """What counts as a copy, and how surely it is found.

    ``similarity``: an item occurs where some stretch of the text is within
    (1 - similarity) times the item's bytes in edits.  ``recall`` is the share
    of items, changed at random by as many edits, that the tables must find.
    ``most_tables`` bounds them.
    """

    similarity: float = 0.8
    recall: float = 0.99
    most_tables: int = 64
    block_bytes: int = 1 << 19

    def edits(self, size: int) -> int:
        return int((1 - self.similarity) * size + 1e-9)


@dataclass(frozen=True)
class Shape:
    """Items of ``least`` bytes or more (up to the next shape): coordinates of a table, four steps apart, and the stride of the windows."""

    least: int
    coordinates: int
    stride: int


SHAPES = (Shape(1, 1, 1), Shape(4, 2, 1), Shape(16, 3, 1), Shape(32, 6, 4), Shape(64, 10, 8))


def plain(text: str | None) -> bytes:
    """What is compared: UTF-8 with A-Z in lower case and white space as blanks, trimmed."""
    return _PLAIN[np.frombuffer((text or "").encode(), np.uint8)].tobytes().strip(b" ")


def best_match(item: bytes, text: bytes) -> tuple[int, int, int]:
    """``(distance, start, end)`` of the stretch of ``text`` nearest to ``item``: Myers' bit-vector search, both ways.

    Of equally near ones the first end and, for it, the latest start.
    """
    distance, end = _search(item, text, True)
    back = _search(item[::-1], text[:end][::-1], False)
    return distance, end - back[1], end


def _search(item: bytes, text: bytes, free: bool) -> tuple[int, int]:
    n = len(item)
    if not n:
        return 0, 0
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    plus, minus, score, best = full, 0, n, (n, 0)
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = (minus | ~(d0 | plus)) & full, d0 & plus
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = ((hp << 1) | (0 if free else 1)) & full
        hn = (hn << 1) & full
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best[0]:
            best = score, j + 1
    return best


def codes(low: np.ndarray) -> np.ndarray:
    """The kinds of each byte and the three after it."""
    kind = np.zeros(len(low) + 3, np.uint16)
    kind[: len(low)] = _KIND[low]
    return kind[:-3] | kind[1:-2] << 4 | kind[2:-1] << 8 | kind[3:] << 12


def walk(table: int, coordinates: int) -> list[np.ndarray]:
    """How far four steps go from a place with a code, for each coordinate after the first."""
    bits = np.random.default_rng(table).integers(0, 2, (4 * coordinates, 16))
    code, out = np.arange(1 << 16), []
    for first in range(0, 4 * coordinates - 4, 4):
        on = np.zeros(1 << 16, np.int64)
        for step in range(first, first + 4):
            on += bits[step][(code >> 4 * on) & 15]
        out.append(on)
    return out


def sampled(low: np.ndarray, code: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the coordinates of the walks from ``start``, and where these ended; ``low`` goes on long enough."""
    at = start
    key = low[at].astype(_U)
    for on in steps:
        at = at + on[code[at]]
        key = key * _U(0x9E3779B97F4A7C15) + low[at]
    return mix(key), at


def _spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, zeros between; the text and the offset in it of each byte of theirs."""
    low = np.frombuffer(b"".join(t + bytes(_SPACE) for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return low, owner, offset


def changed(text: bytes, edits: int, rng: random.Random) -> bytes:
    """``text`` after random edits, half of them replacements, the others insertions and deletions alike."""
    out = bytearray(text)
    for _ in range(edits):
        kind, i, c = rng.random(), rng.randrange(len(out) + 1), rng.choice(b"abcdefghijklmnopqrstuvwxyz")
        if kind < 0.25 or i == len(out):
            out.insert(i, c)
        elif kind < 0.5 and len(out) > 1:
            del out[i]
        else:
            out[i] = c
    return bytes(out)


def tables_needed(texts: list[bytes], shape: Shape, p: Leaks, trials: int = 400) -> int:
    """Tables by which ``p.recall`` of the changed texts share a sample with theirs; measured on ``trials`` copies of up to as many texts."""
    rng = random.Random(len(texts))
    some = sorted(texts, key=lambda t: hash_of(t))[:trials]
    some = (some * (trials // len(some) + 1))[:trials]
    low, owner, offset = _spaced(some)
    other, its_owner, its_offset = _spaced([changed(t, p.edits(len(t)), rng) for t in some])
    here = np.arange(len(owner)) + _SPACE * owner
    phase = np.array([rng.randrange(shape.stride) for _ in some])
    stands = its_offset % shape.stride == phase[its_owner]
    there, its = (np.arange(len(its_owner)) + _SPACE * its_owner)[stands], its_owner[stands].astype(_U)
    end, code, its_code = (here - offset + np.array([len(t) for t in some])[owner]), codes(low), codes(other)
    found = np.zeros(trials, bool)
    for table in range(p.most_tables):
        steps = walk(table, shape.coordinates)
        key, last = sampled(low, code, here, steps)
        key = key[last < end] ^ owner[last < end].astype(_U)
        hit = np.isin(sampled(other, its_code, there, steps)[0] ^ its, key)
        found[its_owner[stands][hit]] = True
        if found.mean() >= p.recall:
            return table + 1
    return p.most_tables


def hash_of(text: bytes) -> int:
    return int(mix(np.array([len(text), *text], _U) * _U(0x9E3779B97F4A7C15)).sum())


class Tables:
    """One block of distinct item texts, and the samples of their walks; built where they are used."""

    def __init__(self, texts: list[str], p: Leaks) -> None:
        self.p = p
        kept = [(t, body) for t in texts if (body := plain(t))]
        self.names, self.texts = [t for t, _ in kept], [body for _, body in kept]
        self.needed: list[tuple[int, Shape, int]] = []
        for shape, least in zip(SHAPES, [*(x.least for x in SHAPES[1:]), math.inf]):
            if own := [t for t in self.texts if shape.least <= len(t) < least]:
                self.needed.append((least, shape, tables_needed(own, shape, p)))
        self.built = False

    def _build(self) -> None:
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.edits = np.array([self.p.edits(n) for n in self.size], np.int64)
        # Blocks of up to 64 bytes begin every 32 bytes; the last ends with the item.
        begins = [sorted({*range(0, max(1, int(n) - 63), 32), max(0, int(n) - 64)}) for n in self.size]
        self.first_block = np.cumsum([0, *map(len, begins)])
        self.begin = np.array([o for b in begins for o in b], np.int64)
        self.owner = np.repeat(np.arange(len(begins)), np.diff(self.first_block))
        self.width = np.minimum(64, self.size[self.owner] - self.begin)
        self.most = np.minimum(self.width, (2 * (1 - self.p.similarity) * self.width).astype(np.int64))
        self.at = np.zeros((len(self.begin), 256), _U)
        low, owner, offset = _spaced(self.texts)
        place = np.arange(len(owner)) + _SPACE * owner
        whole = place[offset == 0]
        for j in range(64):
            r = np.flatnonzero(self.width > j)
            self.at[r, low[whole[self.owner[r]] + self.begin[r] + j]] |= _U(1 << j)
        code, self.tables = codes(low), []
        for least, shape, count in self.needed:
            mine = (self.size[owner] >= shape.least) & (self.size[owner] < least)
            for table in range(count):
                steps = walk(table, shape.coordinates)
                key, last = sampled(low, code, place[mine], steps)
                inside = last < place[mine] - offset[mine] + self.size[owner[mine]]
                key, item, o = key[inside], owner[mine][inside], offset[mine][inside]
                order = np.argsort(key, kind="stable")
                known, first, times = np.unique(key[order], return_index=True, return_counts=True)
                bits = max(20, int(len(known)).bit_length() + 4)
                maybe = np.zeros(1 << bits, bool)
                maybe[(known >> _U(64 - bits)).astype(np.int64)] = True
                self.tables.append((shape.stride, steps, known, first, times, item[order], o[order], maybe, _U(64 - bits)))
        self.built = True

    def _meetings(self, low: np.ndarray, code: np.ndarray, a: int, b: int) -> Iterator[np.ndarray]:
        """``(block, place)`` for the windows from a to b of ``low``: the item's block in which a sample met, and where it would begin."""
        for stride, steps, known, first, times, item, offset, maybe, shift in self.tables:
            start = np.arange(-(-a // stride) * stride, b, stride)
            if not len(start) or not len(known):
                continue
            key, _ = sampled(low, code, start, steps)
            on = np.flatnonzero(maybe[(key >> shift).astype(np.int64)])
            pos = np.minimum(np.searchsorted(known, key[on]), len(known) - 1)
            hit = known[pos] == key[on]
            on, pos = start[on[hit]], pos[hit]
            ends = np.cumsum(times[pos])
            lo = 0
            while lo < len(on):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000, "right")))
                each = times[pos[lo:hi]]
                last = np.cumsum(each)
                entry = np.arange(last[-1]) + np.repeat(first[pos[lo:hi]] - last + each, each)
                i, o = item[entry], offset[entry]
                nth = np.clip((o - 16) // 32, 0, np.diff(self.first_block)[i] - 1)
                block = self.first_block[i] + nth
                place = np.repeat(on[lo:hi], each) - o + self.begin[block]
                # Places less than 16 bytes apart are looked at together.
                yield np.unique(block << 40 | place + 128 >> 4)
                lo = hi

    def _near(self, low: np.ndarray, block: np.ndarray, start: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Whether a block lies within its edits in the 112 bytes from ``start``: Myers' search, many at once."""
        keep, one, table = np.zeros(len(block), bool), _U(1), self.at.ravel()
        for k in range(0, len(block), lanes):
            own, begin = block[k : k + lanes], start[k : k + lanes]
            row, top = own * 256, (self.width[own] - 1).astype(_U)
            score = self.width[own].copy()
            best = score.copy()
            plus, minus = np.full(len(own), ~_U(0)), np.zeros(len(own), _U)
            for j in range(112):
                eq = table[row + low[begin + j]]
                x = eq | minus
                d0 = (((eq & plus) + plus) ^ plus) | eq | minus
                hp, hn = minus | ~(d0 | plus), plus & d0
                score += ((hp >> top) & one).view(np.int64)
                score -= ((hn >> top) & one).view(np.int64)
                np.minimum(best, score, out=best)
                hp <<= one
                hn <<= one
                plus, minus = hn | ~(x | hp), hp & x
            keep[k : k + lanes] = best <= self.most[own]
        return keep

    def _joined(self, stretches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        now = None
        for item, a, b in sorted(stretches):
            if now and now[0] == item and a <= now[2]:
                now = item, now[1], max(b, now[2])
            else:
                if now:
                    yield now
                now = item, a, b
        if now:
            yield now

    def search(self, flat: np.ndarray, offsets: np.ndarray, piece: int = 1 << 17) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, distance, start, end)`` of the best occurrence of each item in each text; byte offsets."""
        if not self.texts or not len(flat):
            return
        if not self.built:
            self._build()
        n = len(flat)
        low = np.zeros(n + 4 * _SPACE, np.uint8)
        low[:n] = _PLAIN[flat]
        stretches: list[tuple[int, int, int]] = []
        for a in range(0, n, piece):
            b = min(n, a + piece)
            code = codes(low[a : b + _SPACE])
            met = list(self._meetings(low[a : b + _SPACE], code, 0, b - a))
            if not met:
                continue
            met = np.unique(np.concatenate(met))
            block, start = met >> 40, a + ((met & ((1 << 40) - 1)) << 4) - 144
            first = np.maximum(start, 0)
            on = self._near(low, block, first)
            for r, x in zip(block[on].tolist(), start[on].tolist()):
                item = int(self.owner[r])
                k, begin = int(self.edits[item]), x + 16 - int(self.begin[r])
                stretches.append((item, max(0, begin - k - 16), begin + int(self.size[item]) + k + 32))
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, a, b in list(self._joined(stretches)):
            body, most = self.texts[item], int(self.edits[item])
            for i in range(int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets[:-1], b, "left"))):
                first, last = max(a, int(offsets[i])), min(b, int(offsets[i + 1]))
                if last - first < len(body) - most:
                    continue
                part = low[first:last].tobytes()
                if _search(body, part, True)[0] > most:
                    continue
                d, x, y = best_match(body, part)
                new = (d, first - int(offsets[i]) + x, first - int(offsets[i]) + y)
                out[i, item] = min(out.get((i, item), new), new)
        for (i, item), (d, x, y) in sorted(out.items()):
            yield i, item, d, x, y


def _blocks(items: DataFrame, p: Leaks) -> Iterator[Tables]:
    """The distinct texts of the benchmark in blocks of bounded size, so that what goes to the executors at once is bounded too."""
    rows = items.select("text").where(F.col("text").isNotNull()).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(size["b"] / p.block_bytes))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield Tables(sorted(r["text"] for r in part.collect()), p)


def leaks(docs: DataFrame, items: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """``(doc_id, item_id, distance, similarity, start, end)`` for each item that occurs in a document of ``docs(doc_id, text)``.

    start and end (exclusive) are code points of the best occurrence, the
    nearest and then the first.  Null, empty and blank texts or items match
    nothing; a repeated row of either table repeats its rows.  A benchmark
    larger than a block costs one pass over the documents for each block.
    """
    schema = "doc_id long, item string, distance long, similarity double, start long, end long"
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for tables in _blocks(items, p):
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            tables = shared.value
            for batch in batches:
                flat, offsets = utf8(batch.column(1))
                ids, rows = batch.column(0).to_pylist(), []
                for i, item, d, x, y in tables.search(flat, offsets):
                    starts = np.cumsum((flat[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)
                    a, b = (int(starts[x - 1]) if x else 0), (int(starts[y - 1]) if y else 0)
                    rows.append((ids[i], tables.names[item], d, 1 - d / len(tables.texts[item]), a, b))
                columns = list(zip(*rows)) or [[]] * 6
                types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item", "distance", "similarity", "start", "end"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    ids = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    return out.join(ids, "item").select("doc_id", "item_id", "distance", "similarity", "start", "end")


def clean(docs: DataFrame, items: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item occurs; a null or empty text stays."""
    bounded_batches(docs.sparkSession)
    names, out = docs.columns, docs
    for tables in _blocks(items, p):
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            tables = shared.value
            for batch in batches:
                flat, offsets = utf8(batch.column(names.index("text")))
                keep = np.ones(len(batch), bool)
                keep[[i for i, *_ in tables.search(flat, offsets)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
