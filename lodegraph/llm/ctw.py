"""Language-model scoring by context-tree weighting over bytes.

Willems, Shtarkov and Tjalkens, "The context-tree weighting method" (1995),
with each byte decomposed into eight binary decisions.  A node is a context of
0 to ``depth`` bytes with the bits of the byte so far; it estimates by
Krichevsky-Trofimov and is mixed with its longer contexts by the weight that
the training corpus gave it.  A text's code length is the sum over its bytes.

Nothing of the tree is cut, gathered or broadcast.  Distinct windows are dealt
by ranges of the context one byte short of the longest, of which each has at
most 65,536 windows, and the two longest context lengths are worked out there.
Shorter ones follow level by level, each an aggregation by the next shorter
context.  The nodes of a window are joined to it from the root down.  Documents
are dealt into chunks by a hash; a chunk's distinct windows and words are joined
with their probabilities and counts, packed by chunk, and meet its texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodegraph.llm.scratch import bounded_batches, discard, written
from lodegraph.llm.words import pieces, utf8, words

_U = np.uint64
_WORD, _WINDOW, _DOC = 0, 1, 2
_VALUE = {_WORD: np.float64, _WINDOW: np.float32}
#: Bytes of text that a chunk has on average.
_CHUNK_BYTES = 16 << 20


@dataclass(frozen=True)
class Ctw:
    """Contexts of up to ``depth`` bytes; those seen less often than ``least_count`` leave it to shorter ones."""

    depth: int = 5
    least_count: int = 1

    def __post_init__(self) -> None:
        if not 2 <= self.depth <= 6:
            raise ValueError("depth is 2 to 6 bytes")

    def windows(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each byte with the ``depth`` before it in its text, zeros before its beginning."""
        place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
        out = flat.astype(_U)
        for j in range(1, self.depth + 1):
            before = np.zeros(len(flat), _U)
            before[j:] = flat[:-j] if j < len(flat) else 0
            before[place < j] = 0
            out |= before << _U(8 * j)
        return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive values, by Stirling's series eight steps up."""
    up = np.ones_like(x)
    for i in range(8):
        up *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    a, b = zeros.astype(float), ones.astype(float)
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts[:0]


@dataclass
class _Level:
    """Nodes of one context length and number of bits; group: context and bits, sorted."""

    group: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray | None = None
    log_w: np.ndarray | None = None


def levels(keys: np.ndarray, counts: np.ndarray, d: int) -> list[_Level]:
    """From windows of d + 1 bytes, sorted."""
    out = []
    for i in range(8):
        group = keys >> _U(8 - i)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        bit = (keys >> _U(7 - i)) & _U(1)
        total, ones = (np.add.reduceat(x, first) if len(first) else counts[:0] for x in (counts, counts * bit.astype(np.int64)))
        out.append(_Level(group[first], total - ones, ones))
    return out


def weigh(nodes: list[_Level], longer: list[_Level] | None, d: int) -> None:
    """Weights and weighted log probabilities of the nodes of context length d, from those of the next length."""
    for i, x in enumerate(nodes):
        kt = log_kt(x.zeros, x.ones)
        if longer is None:
            x.weight, x.log_w = np.ones(len(kt)), kt
        else:
            parent = longer[i].group & _U((1 << (8 * d + i)) - 1)
            below = np.bincount(np.searchsorted(x.group, parent), longer[i].log_w, minlength=len(kt))
            x.weight = 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
            x.log_w = np.logaddexp(kt, below) - math.log(2)


def _mask(n_bytes: int) -> np.uint64:
    return _U((1 << (8 * n_bytes)) - 1)


def _firsts(keys: np.ndarray, i: int) -> np.ndarray:
    """Places of sorted ``keys`` at which a node of ``i`` bits begins."""
    group = keys >> _U(8 - i)
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _own_bit(keys: np.ndarray, i: int, x: _Level, at: np.ndarray, p: Ctw) -> np.ndarray:
    """What nodes ``at`` of a level say to bit ``i`` of each key; NaN where they are seen too rarely."""
    n = (x.zeros + x.ones)[at]
    seen = np.where((keys >> _U(7 - i)) & _U(1) != 0, x.ones[at], x.zeros[at])
    return np.where(n >= max(1, p.least_count), (seen + 0.5) / (n + 1), np.nan)


def _whole_contexts(batches: Iterator[pa.RecordBatch], context_bytes: int, rows: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come context by context, about ``rows`` at once and no context apart, sorted by key."""
    held: list[list[np.ndarray]] = []

    def cut(last: bool) -> Iterator[list[np.ndarray]]:
        whole = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        context = (whole[0].view(_U) >> _U(8)) & _mask(context_bytes)
        end = len(context) if last else int(np.flatnonzero(context != context[-1])[-1]) + 1 if (context != context[-1]).any() else 0
        if end < len(context):
            held.append([c[end:] for c in whole])
        if end:
            order = np.argsort(whole[0][:end].view(_U))
            yield [c[:end][order] for c in whole]

    size = 0
    for batch in batches:
        if len(batch):
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size > rows:
                yield from cut(False)
                size = 0
    if held:
        yield from cut(True)


_UP = ", ".join(f"b{i} double" for i in range(8))


def _deep(windows: DataFrame, p: Ctw) -> DataFrame:
    """``windows(key, n)`` -> the two longest context lengths.

    Rows with ``q``: of each window the probabilities of its eight bits by
    these nodes, NaN where there are none.  Rows without: for each context two
    bytes shorter than the longest, and byte, its count and the summed log
    probabilities of the longer nodes, each put to the first byte under it.
    """
    size = p.depth - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for signed, counts in _whole_contexts(batches, size):
            keys = signed.view(_U)
            long = levels(keys, counts, p.depth)
            weigh(long, None, p.depth)
            near, n = _summed(keys & _mask(p.depth), counts)
            short = levels(near, n, size)
            weigh(short, long, size)
            q = np.empty((len(keys), 8), np.float32)
            up = np.zeros((8, len(near)))
            for i in range(8):
                mine = _own_bit(keys, i, long[i], np.searchsorted(long[i].group, keys >> _U(8 - i)), p)
                at = np.searchsorted(short[i].group, (keys & _mask(p.depth)) >> _U(8 - i))
                above, w = _own_bit(keys, i, short[i], at, p), short[i].weight[at]
                q[:, i] = np.where(np.isnan(mine), above, w * above + (1 - w) * mine)
                up[i, _firsts(near, i)] = short[i].log_w
            parent = near & _mask(size)
            order = np.argsort(parent, kind="stable")
            parent = parent[order]
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            for a in range(0, len(keys), 50_000):
                part = q[a : a + 50_000]
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, 32 * len(part) + 1, 32, dtype=np.int32)), pa.py_buffer(part.tobytes())])
                none = pa.nulls(len(part), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(signed[a : a + 50_000]), pa.nulls(len(part), pa.int64()), packed, *[none] * 8], names)
            sums = [pa.array(np.add.reduceat(x[order], first)) for x in up]
            yield pa.RecordBatch.from_arrays([pa.array(parent[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first)), pa.nulls(len(first), pa.binary()), *sums], names)

    names = ["key", "n", "q", *(f"b{i}" for i in range(8))]
    # The byte nearest to the coded one leads, so that a range holds neighbours in the tree.
    order = F.expr(" | ".join(f"(((key >> {8 * (j + 1)}) & 255) << {8 * (size - 1 - j)})" for j in range(size)))
    return windows.select("key", "n", order.alias("o")).repartitionByRange("o").sortWithinPartitions("o").select("key", "n").mapInArrow(run, f"key long, n long, q binary, {_UP}")


def _level(rows: DataFrame, d: int, p: Ctw) -> DataFrame:
    """``(key, n, b0..b7)`` of context length d -> the same for its parents, not yet summed, with each key's ``own``.

    own: for the key's eight bits, what the nodes say (NaN: seen too rarely), then their weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for signed, n, *below in _whole_contexts(batches, d):
            keys = signed.view(_U)
            own, up = np.empty((len(keys), 16)), np.zeros((8, len(keys)))
            for i, x in enumerate(levels(keys, n, d)):
                first = _firsts(keys, i)
                kt, longer = log_kt(x.zeros, x.ones), np.add.reduceat(below[i], first)
                weight = 1 / (1 + np.exp(np.clip(longer - kt, -700, 700)))
                up[i, first] = np.logaddexp(kt, longer) - math.log(2)
                at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
                own[:, i], own[:, 8 + i] = _own_bit(keys, i, x, at, p), weight[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed), pa.array(n), pa.array([x.tobytes() for x in own], pa.binary()), *map(pa.array, up)], ["key", "n", "own", *(f"b{i}" for i in range(8))])

    context = F.shiftright("key", 8)
    return rows.repartition(context).sortWithinPartitions(context).mapInArrow(run, f"key long, n long, own binary, {_UP}")


def _joined_floats(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _lengthened(path: DataFrame, level: DataFrame, d: int) -> DataFrame:
    """``(key, path)`` of context length d from those of d - 1 and the nodes of length d.

    A path, for eight bits: the probability so far, the share left for longer contexts, what the longest node seen says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, so_far = _joined_floats(batch.column(1), 16, float), _joined_floats(batch.column(2), 24, float)
            says, weight, done, left, last = own[:, :8], own[:, 8:], so_far[:, :8], so_far[:, 8:16], so_far[:, 16:]
            live = ~np.isnan(says)
            out = np.concatenate([np.where(live, done + left * weight * says, done), np.where(live, left * (1 - weight), left), np.where(live, says, last)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["key", "path"])

    if d == 0:
        start = np.concatenate([np.zeros(8), np.ones(8), np.full(8, 0.5)]).tobytes()
        both = level.select("key", "own", F.lit(bytearray(start)).alias("path"))
    else:
        short = path.withColumnRenamed("key", "short")
        both = level.select("key", "own").join(short, F.col("key").bitwiseAND(F.lit(int(_mask(d)))) == F.col("short")).select("key", "own", "path")
    return both.mapInArrow(run, "key long, path binary")


def window_scores(windows: DataFrame, p: Ctw) -> DataFrame:
    """``windows(key, n)`` -> ``(key, score)``: log10 probability of each window's last byte, by the tree of all of them.

    Windows of which n is 0 are scored and not learned from.
    """
    deep = written(_deep(windows, p), "context-deep")
    sums = [F.sum("n").alias("n"), *(F.sum(f"b{i}").alias(f"b{i}") for i in range(8))]
    rows, own = deep.where("q is null").groupBy("key").agg(*sums), {}
    for d in range(p.depth - 2, -1, -1):
        own[d] = written(_level(rows, d, p), "context-level")
        rows = own[d].groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(d)))).alias("key")).agg(*sums)
    path = None
    for d in range(p.depth - 1):
        longer = written(_lengthened(path, own[d], d), "context-path")
        discard(own[d], *([path] if path else []))
        path = longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, so_far = _joined_floats(batch.column(1), 8, np.float32), _joined_floats(batch.column(2), 24, float)
            total = so_far[:, :8] + so_far[:, 8:16] * np.where(np.isnan(q), so_far[:, 16:], q)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(total).sum(axis=1))], ["key", "score"])

    both = deep.where("q is not null").join(path.withColumnRenamed("key", "short"), F.col("key").bitwiseAND(F.lit(int(_mask(p.depth - 1)))) == F.col("short"))
    out = written(both.select("key", "q", "path").mapInArrow(run, "key long, score double"), "context-scores")
    discard(deep, path)
    return out


@dataclass
class Model:
    """A whole tree in memory, to hold window_scores against; by context length and number of bits:
    nodes (context and bits, sorted), probability of a one, weight."""

    depth: int
    nodes: list[list[np.ndarray]]
    one: list[list[np.ndarray]]
    weight: list[list[np.ndarray]]

    def log10_of(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each window given the others."""
        out = np.zeros(len(keys))
        for i in range(8):
            bit = ((keys >> _U(7 - i)) & _U(1)).astype(bool)
            path, live = [], np.arange(len(keys))
            for d in range(self.depth + 1):
                known = self.nodes[d][i]
                if not len(known) or not len(live):
                    break
                group = (keys[live] >> _U(8 - i)) & _U((1 << (8 * d + i)) - 1)
                at = np.minimum(np.searchsorted(known, group), len(known) - 1)
                hit = known[at] == group
                live, at = live[hit], at[hit]
                path.append((live, at))
            q = np.full(len(keys), 0.5)
            deepest = np.full(len(keys), -1)
            for d, (live, _) in enumerate(path):
                deepest[live] = d
            for d in range(len(path) - 1, -1, -1):
                live, at = path[d]
                one = self.one[d][i][at]
                mine = np.where(bit[live], one, 1 - one)
                w = np.where(deepest[live] == d, 1.0, self.weight[d][i][at])
                q[live] = w * mine + (1 - w) * q[live]
            out += np.log10(q)
        return out


def model(windows: DataFrame, p: Ctw) -> Model:
    """The tree of few windows, gathered; score doesn't use it."""
    rows = windows.select("key", "n").toArrow()
    keys, counts = _summed(rows.column(0).to_numpy().view(_U), rows.column(1).to_numpy())
    out, longer = Model(p.depth, [], [], []), None
    for d in range(p.depth, -1, -1):
        keys, counts = _summed(keys & _mask(d + 1), counts)
        nodes = levels(keys, counts, d)
        weigh(nodes, longer, d)
        kept = [np.flatnonzero(x.zeros + x.ones >= max(1, p.least_count)) for x in nodes]
        out.nodes.insert(0, [x.group[k] for x, k in zip(nodes, kept)])
        out.one.insert(0, [((x.ones + 0.5) / (x.zeros + x.ones + 1))[k] for x, k in zip(nodes, kept)])
        out.weight.insert(0, [x.weight[k] for x, k in zip(nodes, kept)])
        longer = nodes
    return out


def _distinct(keys: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys))) * count


def _chunk_keys(docs: DataFrame, p: Ctw, most: int = 2_500_000) -> DataFrame:
    """``docs(chunk, held_out, text)``, chunk by chunk -> ``(what, chunk, key, n)``: a chunk's words and windows with their training counts.

    A key comes again where a chunk has more than ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: int | None = None
        held: dict[int, list[tuple]] = {_WORD: [], _WINDOW: []}

        def gathered() -> int:
            """Merges what is held of each kind; returns the number of keys."""
            for pairs in held.values():
                pairs[:] = [_summed(*(np.concatenate(x) for x in zip(*pairs)))] if pairs else []
            return sum(len(k) for pairs in held.values() for k, _ in pairs)

        def flush() -> Iterator[pa.RecordBatch]:
            gathered()
            for what, pairs in held.items():
                for keys, n in pairs:
                    for a in range(0, len(keys), 50_000):
                        k = keys[a : a + 50_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), what, np.int8)), pa.array(np.full(len(k), chunk)), pa.array(k), pa.array(n[a : a + 50_000])], ["what", "chunk", "key", "n"])
                pairs.clear()

        for batch in batches:
            which = batch.column(0).to_numpy()
            flat, offsets = utf8(batch.column(2))
            test = np.array(batch.column(1).to_pylist(), bool)
            for a, b in _runs(which, pieces(offsets)):
                if which[a] != chunk:
                    yield from flush()
                    chunk = int(which[a])
                part, own = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w, keys = words(part, own), p.windows(part, own)
                for what, k, each in ((_WORD, w.hashes, np.diff(w.bounds)), (_WINDOW, keys, np.diff(own))):
                    train = np.repeat(~test[a:b], each)
                    held[what] += [_distinct(k[train], True), _distinct(k[~train], False)]
                if sum(len(k) for x in held.values() for k, _ in x) > most and gathered() > 2 * most // 3:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "what tinyint, chunk long, key long, n long")


def _runs(which: np.ndarray, ranges: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The ranges, cut where ``which`` changes."""
    cuts = np.flatnonzero(np.diff(which)) + 1 if len(which) else np.zeros(0, np.int64)
    for a, b in ranges:
        edges = [a, *cuts[(cuts > a) & (cuts < b)].tolist(), b]
        yield from zip(edges[:-1], edges[1:])


def _packed(known: DataFrame, most: int = 500_000) -> DataFrame:
    """``(what, chunk, key, value)`` -> ``(what, chunk, size, pack)``: up to ``most`` rows at once, those of a chunk sorted by key and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            what, chunk, key, value = (np.concatenate(c) for c in zip(*held))
            held.clear()
            key, group = key.view(_U), chunk * 4 + what
            order = np.lexsort((key, group))
            group, key, value = group[order], key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rows = []
            for a, b in zip(first, [*first[1:], len(group)]):
                kind = int(group[a] & 3)
                # Bytes of like weight stand together, so that the high ones, mostly zeros, take no room.
                raw = b"".join(x.view(np.uint8).reshape(b - a, -1).T.tobytes() for x in (np.diff(key[a:b], prepend=_U(0)), value[a:b].astype(_VALUE[kind])))
                rows.append((kind, int(group[a] >> 2), int(b - a), pa.compress(raw, "zstd", asbytes=True)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int8(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["what", "chunk", "size", "pack"])

        for batch in batches:
            if len(batch):
                held.append([c.to_numpy() for c in batch.columns])
                size += len(batch)
                if size > most:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return known.mapInArrow(run, "what tinyint, chunk long, size long, pack binary")


def _unpacked(kind: int, size: int, pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = np.dtype(_VALUE[kind]).itemsize
    raw = np.frombuffer(pa.decompress(pack, decompressed_size=(8 + width) * size, codec="zstd"), np.uint8)
    step, value = (np.ascontiguousarray(x.reshape(-1, size).T).view(t).ravel() for x, t in ((raw[: 8 * size], _U), (raw[8 * size :], _VALUE[kind])))
    return np.cumsum(step, dtype=_U), value


def score(docs: DataFrame, held_out: Column, p: Ctw = Ctw()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``.

    Learns from the rows where ``held_out`` is false.  score is the model's
    log10 probability of the whole text, 0 for an empty or null one, whose
    bits_per_byte is null.  base_score sums log10((c + 1) / (N + V + 1)) over
    the words and one end.  With nothing to learn from, every bit costs one
    bit and every count is 0.  A row's columns but these two are not looked at,
    and a repeated row counts each time.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends, chunks = size["ends"], size["bytes"] // _CHUNK_BYTES + 1
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    own = written(_chunk_keys(dealt.select("chunk", "held_out", "text").repartition("chunk").sortWithinPartitions("chunk"), p), "chunk-keys")
    counts = lambda what: own.where(f"what = {what}").groupBy("key").agg(F.sum("n").alias("n"))
    vocabulary = written(counts(_WORD).where("n > 0"), "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_kinds = total["n"] + ends, total["v"] + (ends > 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_token, end = math.log10(n_train + n_kinds + 1), math.log10(ends + 1)
        chunk, found, tables = None, {}, {}

        def looked_up(what: int, keys: np.ndarray) -> np.ndarray:
            known, value = tables[what]
            if not len(known):
                return np.zeros(len(keys))
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[at] == keys, value[at], 0.0)

        for batch in batches:
            which, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(which) != 0) | (np.diff(what) != 0)) + 1, [len(which)]]) if len(which) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if which[a] != chunk:
                    chunk, found, tables = which[a], {_WORD: [], _WINDOW: []}, {}
                part = batch.slice(a, b - a)
                if what[a] != _DOC:
                    found[what[a]] += [_unpacked(what[a], n, x) for n, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                    continue
                if not tables:
                    for k, pairs in found.items():
                        keys, value = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, _U), np.zeros(0, np.float32))
                        order = np.argsort(keys)
                        tables[k] = keys[order], value[order]
                    found = {}
                flat, offsets = utf8(part.column(6))
                ids, test = part.column(4).to_pylist(), part.column(5).to_pylist()
                out = []
                for x, y in pieces(offsets):
                    body, at = flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                    w = words(body, at)
                    c = looked_up(_WORD, w.hashes)
                    running = [np.concatenate([[0], np.cumsum(z, dtype=float)]) for z in (c > 0, c, looked_up(_WINDOW, p.windows(body, at)))]
                    seen, base, scores = (np.diff(z[e]) + 0.0 for z, e in zip(running, (w.bounds, w.bounds, at)))
                    tokens, sizes = np.diff(w.bounds) + 1, np.diff(at)
                    for i in range(y - x):
                        out.append((ids[x + i], test[x + i], int(tokens[i]), int(seen[i]) + (ends > 0), n_train, float(base[i]) + end - int(tokens[i]) * per_token, float(scores[i]), float(-scores[i] * math.log2(10) / sizes[i]) if sizes[i] else None))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    null = lambda t: F.lit(None).cast(t)
    windows = window_scores(counts(_WINDOW), p)
    # Of a word, log10 of its count and one more, which is above 0 for those known.
    value = {_WORD: F.log10(F.col("n") + 1), _WINDOW: F.col("score")}
    known = [own.where(f"what = {k}").select("what", "chunk", "key").join(table.select("key", value[k].alias("value")), "key").select("what", "chunk", "key", "value") for k, table in ((_WORD, vocabulary), (_WINDOW, windows))]
    packed = written(_packed(known[0].unionByName(known[1])), "chunk-packs")
    discard(own, vocabulary, windows)
    packs = packed.select("chunk", "what", "size", "pack", null("long").alias("doc_id"), null("boolean").alias("held_out"), null("string").alias("text"))
    texts = dealt.select("chunk", F.lit(_DOC).cast("tinyint").alias("what"), null("long").alias("size"), null("binary").alias("pack"), "doc_id", "held_out", "text")
    ordered = packs.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "what")
    return ordered.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
