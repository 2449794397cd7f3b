"""Encoding and decoding with a SentencePiece vocabulary: N-best segmentation over the piece lattice.

Forward Viterbi scores of all lattice positions are exact heuristics for a
backward A* search, so the first N complete paths popped are the N best.  Where
no piece has two bytes side by side a text's lattice falls apart between them,
if the second begins a character: before blanks (U+2581 in the vocabulary), as
they only begin pieces, and mostly between letters and other signs.  Each
distinct unit between such places is searched once and a text's N best
segmentations follow from its units' N best.  Units of a batch are searched in
lockstep, one pop of each at a time.  Bytes stand only for characters that are
no piece themselves, as in SentencePiece.

With exact heuristics a place's first N pops carry its N best ways to the end,
so no place is opened more often: the work is bounded by N times the edges
whatever the text.  Scores are multiples of 2 ** -24, whose sums are exact: of
equally good segmentations the best is the one with the longest last piece,
then the longest before that, and so on.  The others of a unit come as they
are popped, the latest of equals first; of a text's others that lose the same
the first is the one in which fewer units part from their best, then the one
that does so nearer the text's start.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm.words import pieces as ranges

BLANK = 0xFF  # stands for the vocabulary's blank; no UTF-8 text has this byte
_NONE = -np.inf
_UNIT = float(1 << 24)
_ONE = np.uint64(1)
#: Bytes of the character that a byte begins, 0 for those inside one.
_CHAR = np.repeat([1, 0, 2, 3, 4, 1], [128, 64, 32, 16, 8, 8])
#: Bytes of whole texts that a task encodes and returns at once.
PART_BYTES = 1 << 19


@dataclass
class Vocabulary:
    """Piece bytes (blank as 0xFF) with ids and log probabilities, and the ids of the 256 byte pieces.

    A BPE vocabulary has ranks, not probabilities: these follow Zipf's law,
    1 / (rank + 3), normalised.  A byte costs ``byte_penalty`` nats more than
    the rarest piece.
    """

    pieces: list[tuple[bytes, int]]
    byte_ids: list[int]
    byte_penalty: float = 10.0
    _built: tuple | None = field(default=None, repr=False)
    _encoders: dict[int, Encoder] = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str, byte_penalty: float = 10.0) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids, own = [-1] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own.append((sp.get_score(i), i, b"\xff".join(x.encode() for x in piece.split("▁"))))
        if -1 in byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        if any(b"\xff" in p.lstrip(b"\xff") for _, _, p in own):
            raise ValueError("a piece has a blank after another character")
        own.sort(key=lambda x: (-x[0], x[1]))
        return cls([(p, i) for _, i, p in own], byte_ids, byte_penalty)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_built": None, "_encoders": {}}

    def encoder(self, n: int) -> Encoder:
        """One for each n: a worker's tasks share the units searched."""
        if n not in self._encoders:
            self._encoders[n] = Encoder(self, n)
        return self._encoders[n]

    def tables(self) -> tuple:
        """Trie of the pieces for ``_child``, the piece at each node, scores and bytes by id, the ids of bytes, between which bytes (the first times 256 plus the second) units part; last the bytes of all ids end to end, and where each id's begin and how many those are."""
        if self._built is None:
            odds = 1 / (np.arange(len(self.pieces)) + 3.0)
            logs = np.round(np.log(odds / odds.sum()) * _UNIT) / _UNIT
            top = max([*self.byte_ids, *(i for _, i in self.pieces)]) + 1
            score, body = np.full(top, logs.min() - round(self.byte_penalty * _UNIT) / _UNIT), [b""] * top
            own, ids = [p for p, _ in self.pieces], np.array([i for _, i in self.pieces], np.int32)
            raw, lengths = np.frombuffer(b"".join(own), np.uint8), np.array([len(p) for p in own], np.int64)
            begin, node, nodes, edges = np.cumsum(lengths) - lengths, np.zeros(len(own), np.int64), 1, [np.zeros(0, np.int64)]
            # Nodes are numbered by depth, then by node above and byte: the k-th of all edges leads to node k + 1.
            for depth in range(int(lengths.max(initial=0))):
                on = np.flatnonzero(lengths > depth)
                found, nth = np.unique(node[on] << 8 | raw[begin[on] + depth], return_inverse=True)
                node[on] = nodes + nth
                nodes += len(found)
                edges.append(found)
            edge, bits = np.concatenate(edges), np.zeros(4 * nodes, np.uint64)
            np.bitwise_or.at(bits, edge >> 6, _ONE << (edge & 63).astype(np.uint64))
            ones = np.bitwise_count(bits)
            trie = bits, np.cumsum(ones, dtype=np.int64) - ones
            piece_at = np.full(nodes, -1, np.int32)
            piece_at[node], score[ids] = ids, logs
            for p, i in self.pieces:
                body[i] = p
            for c, i in enumerate(self.byte_ids):
                body[i] = bytes([c])
            sizes = np.array([len(b) for b in body])
            breaks = np.tile(_CHAR > 0, (256, 1))
            for p, _ in self.pieces:
                breaks[list(p[:-1]), list(p[1:])] = False
            flat = np.frombuffer(b"".join(body), np.uint8), np.cumsum(sizes) - sizes, sizes
            self._built = trie, piece_at, score, body, np.array(self.byte_ids, np.int32), breaks.ravel(), *flat
        return self._built

    def split(self, text: str | None) -> list[bytes]:
        """The units of a text with the blank that encoding puts before it; an empty or null text has none."""
        units, codes, _ = self.split_together([text])
        return [units[c] for c in codes.tolist()]

    def split_together(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct units of the texts, the place among these of each unit of each text, and how many units each text has."""
        lines = [b"\xff" + t.encode() if t else b"" for t in texts]
        size = np.array([len(x) for x in lines], np.int64)
        flat = np.frombuffer(bytearray().join(lines), np.uint8)
        flat[flat == 0x20] = BLANK
        begins = np.zeros(len(flat), bool)
        begins[1:] = self.tables()[5][flat[:-1].astype(np.uint16) << 8 | flat[1:]]
        end = np.cumsum(size)
        begins[(end - size)[size > 0]] = True
        first = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(first, len(flat))), pa.py_buffer(flat)]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), buffers).dictionary_encode()
        _, offsets, body = found.dictionary.buffers()
        cut, raw = np.frombuffer(offsets, np.int64)[: len(found.dictionary) + 1].tolist(), body.to_pybytes() if body else b""
        return [raw[a:b] for a, b in zip(cut, cut[1:])], found.indices.to_numpy(), np.diff(np.searchsorted(first, end), prepend=0)

    def decode(self, ids: np.ndarray) -> str:
        *_, flat, first, size = self.tables()
        sizes = size[ids]
        ends = np.cumsum(sizes)
        raw = flat[np.repeat(first[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if len(raw) and raw[0] == BLANK:
            raw = raw[1:]
            raw[raw == BLANK] = 0x20
        return raw.tobytes().decode()


def _child(trie: tuple[np.ndarray, np.ndarray], node: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Where each byte leads from each node, 0 for nowhere.  trie: four words of 64 bits a node, a bit a child, and the bits before each word."""
    bits, before = trie
    at = node << 8 | byte
    word, one = bits[at >> 6], _ONE << (at & 63).astype(np.uint64)
    return np.where(word & one, before[at >> 6] + np.bitwise_count(word & (one - _ONE)) + 1, 0)


@dataclass
class _Lattice:
    """Edges of a batch of units: CSR by end node, the longest first; unit u has the nodes first[u] .. first[u + 1] - 1."""

    first: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    row: np.ndarray  #: edges that end at node n are row[n]:row[n + 1]
    forward: np.ndarray


def lattice(units: list[bytes], vocabulary: Vocabulary) -> _Lattice:
    trie, piece_at, score, _, byte_ids, *_ = vocabulary.tables()
    size = np.array([len(u) for u in units], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.frombuffer(b"".join(u + b"\0" for u in units), np.uint8)
    stop = np.repeat(first[1:] - 1, size + 1)
    at = np.flatnonzero(np.arange(len(flat)) < stop)
    starts, ends, ids = [], [], []
    covered = np.zeros(len(flat), bool)
    node, p, length = np.zeros(len(at), np.int64), at, 0
    while len(p):
        node = _child(trie, node, flat[p + length])
        length += 1
        found = node > 0
        node, p = node[found], p[found]
        whole = piece_at[node]
        done = whole >= 0
        starts.append(p[done])
        ends.append(p[done] + length)
        ids.append(whole[done])
        covered[p[done & (_CHAR[flat[p]] == length)]] = True
        more = p + length < stop[p]
        node, p = node[more], p[more]
    lead = np.maximum.accumulate(np.where(_CHAR[flat] > 0, np.arange(len(flat)), 0))
    byte = at[~covered[lead[at]]]
    # Longest first and then stable by end: the edges of an end come by start.
    start, end, piece = (np.concatenate([*x[::-1], y]) for x, y in ((starts, byte), (ends, byte + 1), (ids, byte_ids[flat[byte]])))
    order = np.argsort(end, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    value = score[piece]
    row = np.searchsorted(end, np.arange(len(flat) + 1))
    forward = np.full(len(flat), _NONE)
    forward[first[:-1]] = 0
    depth = end - np.repeat(first[:-1], size + 1)[end]
    by = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[by], np.arange(1, int(size.max(initial=0)) + 2))
    for a, b in zip(cut[:-1], cut[1:]):
        e = by[a:b]
        if len(e):
            mark = np.flatnonzero(np.concatenate([[True], end[e][1:] != end[e][:-1]]))
            forward[end[e][mark]] = np.maximum.reduceat(forward[start[e]] + value[e], mark)
    return _Lattice(first, start, piece, value, row, forward)


def best_paths(x: _Lattice, u: int, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of one unit by backward A* with a heap; no place is opened more than n times."""
    begin, end = int(x.first[u]), int(x.first[u + 1]) - 1
    row, forward = x.row[begin : end + 2].tolist(), x.forward[begin : end + 1].tolist()
    base = row[0]
    start, piece, score = (v[base : row[-1]].tolist() for v in (x.start, x.piece, x.score))
    heap, out, tick, opened = [(-forward[-1], 0, end - begin, 0.0, None)], [], 0, [0] * (end + 1 - begin)
    while heap and len(out) < n:
        _, _, at, done, path = heapq.heappop(heap)
        if at == 0:
            ids, link = [], path
            while link:
                ids.append(link[0])
                link = link[1]
            out.append((done, ids))
        elif opened[at] < n:
            opened[at] += 1
            for e in range(row[at + 1] - base - 1, row[at] - base - 1, -1):
                before = start[e] - begin
                if opened[before] < n:
                    # Of equal ones the latest is popped first, so the longest piece comes last here.
                    tick -= 1
                    g = done + score[e]
                    heapq.heappush(heap, (-(g + forward[before]), tick, before, g, (piece[e], path)))
    return out


def best_paths_together(x: _Lattice, units: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_paths of many units, one pop of each at a time.

    Returns the scores (units x n, -inf where there are fewer), the ids of all
    these paths end to end, and their number for each path (units x n).
    """
    count, span = len(units), int((x.first[units + 1] - x.first[units]).max())
    scores, got = np.full((count, n), _NONE), np.zeros(count, np.int64)
    ids, sizes = np.full((count, n, span), -1, np.int32), np.zeros((count, n), np.int64)
    live, begin, end, through = np.arange(count), x.first[units], x.first[units + 1] - 1, x.score + x.forward[x.start]
    opened, last_slot = np.zeros((count, span), np.int32), np.zeros((count, n), np.int32)
    # A row is a unit's open list, popped at its greatest f.  It is filled from its right, so that argmax finds the latest of equals; slot k stands k places from the right.
    room, used = 64, np.ones(count, np.int64)
    # A slot has its f, the edge it came by (the first slot none) and the slot before; f less what is best up to its place is its cost.
    f, edge, back = np.full((count, room), _NONE), np.full((count, room), -1, np.int32), np.zeros((count, room), np.int32)
    f[:, -1] = x.forward[end]
    while len(live):
        line, left = np.arange(len(live)), room - int(used.max())
        top = left + f[:, left:].argmax(axis=1)
        cell = line * room + top
        cost, by = f.ravel()[cell], edge.ravel()[cell]
        open_ = cost > _NONE
        place = np.where(open_ & (by >= 0), x.start[by], end)
        cost -= x.forward[place]
        f.ravel()[cell] = _NONE
        whole = open_ & (place == begin)
        w = np.flatnonzero(whole)
        if len(w):
            scores[live[w], got[live[w]]] = cost[w]
            last_slot[w, got[live[w]]] = room - 1 - top[w]
            got[live[w]] += 1
        w = np.flatnonzero(open_ & ~whole & (opened[line, np.where(open_, place - begin, 0)] < n))
        if len(w):
            opened[w, place[w] - begin[w]] += 1
            first = x.row[place[w]]
            degree = x.row[place[w] + 1] - first
            last = np.cumsum(degree)
            nth = np.arange(last[-1]) - np.repeat(last - degree, degree)
            own, e = np.repeat(w, degree), np.repeat(first, degree) + nth
            slot = used[own] + np.repeat(degree, degree) - 1 - nth
            used[w] += degree
            if used.max() > room:
                pad = [(0, 0), (room, 0)]
                f, edge, back = np.pad(f, pad, constant_values=_NONE), np.pad(edge, pad), np.pad(back, pad)
                top += room
                room *= 2
            cell = own * room + (room - 1 - slot)
            f.ravel()[cell], edge.ravel()[cell], back.ravel()[cell] = cost[own] + through[e], e, (room - 1 - top)[own]
        keep = open_ & (got[live] < n)
        if keep.sum() < 0.7 * len(live):
            # Each path of the units that are done, from its first piece on.
            gone = np.flatnonzero(~keep)
            nth, rank = np.nonzero(np.arange(n) < got[live[gone], None])
            own = gone[nth]
            slot, depth = last_slot[own, rank], 0
            while len(own):
                cell = own * room + (room - 1 - slot)
                ids[live[own], rank, depth] = x.piece[edge.ravel()[cell]]
                depth += 1
                sizes[live[own], rank] = depth
                slot = back.ravel()[cell]
                on = slot > 0
                own, rank, slot = own[on], rank[on], slot[on]
            live, begin, end, used, opened, last_slot = (v[keep] for v in (live, begin, end, used, opened, last_slot))
            f, edge, back = f[keep], edge[keep], back[keep]
        else:
            f[~keep] = _NONE
    return scores, ids[np.arange(span) < sizes[:, :, None]], sizes


class Encoder:
    """Encodes texts; keeps up to ``cache`` searched units, then of those that came in more than one batch up to half as many, the most frequent."""

    #: Units longer than this are searched one by one, with the same result: a heap finds its best sooner than a row.
    LONG = 48
    #: Units whose lattice is built at once: so many, or of so many bytes.
    UNITS, BYTES = 2048, 1 << 19

    def __init__(self, vocabulary: Vocabulary, n: int = 3, cache: int = 200_000) -> None:
        self.vocabulary, self.n, self.cache = vocabulary, max(n, 2), cache
        self.at: dict[bytes, int] = {}
        #: Of each unit the scores and numbers of ids of its n best, the ids of all of them end to end, and where its best's begin and how many those are.
        self.scores, self.lengths, self.ids = np.zeros((0, self.n)), np.zeros((0, self.n), np.int64), np.zeros(0, np.int32)
        self.first, self.sizes, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _thin_out(self) -> None:
        half = self.cache // 2
        keep = self.seen > (max(1, np.partition(self.seen, -half)[-half]) if 0 < half <= len(self.seen) else 1)
        self.at = {u: i for i, u in enumerate(u for u, k in zip(self.at, keep.tolist()) if k)}
        self.ids = self.ids[np.repeat(keep, self.lengths.sum(axis=1))]
        self.scores, self.lengths, self.seen = self.scores[keep], self.lengths[keep], self.seen[keep] // 2

    def search(self, units: list[bytes]) -> None:
        """Adds the units to those known."""
        units = sorted(units, key=len)
        scores, lengths, ids = [self.scores], [self.lengths], [self.ids]
        ends = np.cumsum([len(u) for u in units])
        k = 0
        while k < len(units):
            last = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + self.BYTES, "right"))
            part = units[k : min(k + self.UNITS, max(last, k + 1))]
            k += len(part)
            x = lattice(part, self.vocabulary)
            short = sum(len(u) <= self.LONG for u in part)
            if short:
                for out, new in zip((scores, ids, lengths), best_paths_together(x, np.arange(short), self.n)):
                    out.append(new)
            for u in range(short, len(part)):
                paths = best_paths(x, u, self.n)
                none = self.n - len(paths)
                scores.append(np.array([[s for s, _ in paths] + [_NONE] * none]))
                lengths.append(np.array([[len(p) for _, p in paths] + [0] * none]))
                ids += [np.array(p, np.int32) for _, p in paths]
        self.scores, self.lengths, self.ids = np.concatenate(scores), np.concatenate(lengths), np.concatenate(ids)
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        whole = self.lengths.sum(axis=1)
        self.first, self.sizes = np.cumsum(whole) - whole, self.lengths[:, 0]
        self.seen = np.concatenate([self.seen, np.zeros(len(units), np.int64)])

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, float, list[float]]]:
        """``(ids, score, losses)`` of each text: losses of the 2nd .. n-th best segmentation of the whole text, fewer if there are fewer."""
        for best in self.n_best_batch(texts):
            yield best[0][1], best[0][0], [best[0][0] - s for s, _ in best[1:]]

    def n_best_batch(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """``(score, ids)`` of the n best segmentations of each whole text, the best first, fewer if there are fewer."""
        for k in range(0, len(texts), 500):
            present, codes, counts = self.vocabulary.split_together(texts[k : k + 500])
            fresh = [u for u in present if u not in self.at]
            if len(self.at) + len(fresh) > self.cache:
                self._thin_out()
                fresh = [u for u in present if u not in self.at]
            if fresh:
                self.search(fresh)
            place = np.fromiter(map(self.at.__getitem__, present), np.int64, len(present))
            self.seen[place] += 1
            for at in np.split(place[codes], np.cumsum(counts)[:-1]):
                if not len(at):
                    yield [(0.0, np.zeros(0, np.int32))]
                    continue
                sizes = self.sizes[at]
                ends = np.cumsum(sizes)
                ids = self.ids[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
                score = float(self.scores[at, 0].sum())
                yield [(score, ids), *((score - loss, self._parted(at, ids, ends, parts)) for loss, _, parts in self._others(at))]

    def _others(self, at: np.ndarray) -> list[tuple[float, int, tuple[tuple[int, int], ...]]]:
        """What the 2nd to n-th best of a whole text lose, and the units that part from their best: how many, which, and which of their n best each takes."""
        # Only the n - 1 units that lose least can part from their best in one of the n best of the whole.
        least = self.scores[at, 0] - self.scores[at, 1]
        best = [(0.0, 0, ())]
        few = np.flatnonzero(least <= np.partition(least, self.n - 2)[self.n - 2]) if len(least) >= self.n else np.arange(len(least))
        for i in sorted(few[np.argsort(least[few], kind="stable")[: self.n - 1]].tolist()):
            top, *others = self.scores[at[i]].tolist()
            parted = [(top - s, (i, r)) for r, s in enumerate(others, 1) if s > _NONE]
            best = sorted([*best, *((a + b, c + 1, (*parts, part)) for a, c, parts in best for b, part in parted)])[: self.n]
        return best[1:]

    def _parted(self, at: np.ndarray, ids: np.ndarray, ends: np.ndarray, parts: tuple[tuple[int, int], ...]) -> np.ndarray:
        """The ids of a text with some of its units segmented by another of their n best."""
        out, done = [], 0
        for i, r in parts:
            first = self.first[at[i]] + self.lengths[at[i], :r].sum()
            out += [ids[done : ends[i] - self.sizes[at[i]]], self.ids[first : first + self.lengths[at[i], r]]]
            done = ends[i]
        return np.concatenate([*out, ids[done:]])


def _encoded(docs: DataFrame, vocabulary: Vocabulary, n: int, row, schema: str) -> DataFrame:  # noqa: ANN001
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What this worker's earlier tasks freed is Arrow's until it is given back, and so on top of what this one takes.
        pa.default_memory_pool().release_unused()
        encoder = shared.value.encoder(n)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            for a, b in ranges(np.append(0, np.cumsum(sizes)), PART_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                rows = [row(encoder, t, best) for t, best in zip(texts, encoder.n_best_batch(texts))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES[schema]))], names)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_IDS = "doc_id long, ids array<int>, n_tokens long, score double, losses array<double>, others array<array<int>>"
_DIGEST = "doc_id long, n_tokens long, score double, loss double, ids_sha256 string, decoded_sha256 string, exact boolean, losses array<double>, others_sha256 string"
_TYPES = {
    _IDS: (pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32()))),
    _DIGEST: (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.float64()), pa.string()),
}


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids, n_tokens, score, losses, others)``, a row for a row.

    ids: the best segmentation; others: the 2nd to n-th best, whole (as many as
    there are); losses: how much less the log probability of each of these is.
    A null or empty text has no ids, score 0, no losses and no others.
    """

    def row(_: Encoder, text: str | None, best: list[tuple[float, np.ndarray]]) -> tuple:  # noqa: ARG001
        (score, ids), *others = best
        return ids, len(ids), score, [score - s for s, _ in others], [x for _, x in others]

    return _encoded(docs, vocabulary, n, row, _IDS)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, n: int = 3) -> DataFrame:
    """``(doc_id, n_tokens, score, loss, ids_sha256, decoded_sha256, exact, losses, others_sha256)``: digests of the ids (32-bit little-endian) and of the text decoded from them.

    loss: of the second best segmentation, null where there is none; losses: of
    the 2nd to n-th, whose ids' digests others_sha256 has, comma-joined.  exact:
    the text decoded from each of the n best is the text (null: empty).
    """

    def row(encoder: Encoder, text: str | None, best: list[tuple[float, np.ndarray]]) -> tuple:
        (score, ids), *others = best
        back = encoder.vocabulary.decode(ids)
        exact = back == (text or "") and all(encoder.vocabulary.decode(x) == back for _, x in others)
        losses, (digest, *digests) = [score - s for s, _ in others], [hashlib.sha256(x.tobytes()).hexdigest() for _, x in best]
        return len(ids), score, losses[0] if losses else None, digest, hashlib.sha256(back.encode()).hexdigest(), exact, losses, ",".join(digests)

    return _encoded(docs, vocabulary, n, row, _DIGEST)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded(doc_id, ids)`` -> ``(doc_id, text)``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
