"""Personal data: base patterns, made consistent over each document by a skip-chain conditional random field.

Sutton and McCallum, "Collective Segmentation and Labeling of Distant
Entities" (2004).  The field's variables are a document's candidate tokens,
those with a digit or an at sign, and its classes: all equal tokens, all of the
same digits, all of the same mail name.  Neighbours share chain potentials; a
token shares a skip potential with each of its classes.  A token that no
pattern matched is hidden, no evidence for or against, however often it comes;
a class has the potential of its shape once.  Loopy belief propagation, run to
convergence over all documents of a batch at once, labels the hidden tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm.sampling import distinct_texts

# The base kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match begins where a run of digits does; said so, long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

_EDGE = ".,;:!?()[]<>\"'"

OTHER = len(KINDS)  # the label of a token that is no personal data
LABELS = OTHER + 1
_SHAPES = 4 * 2 * 2 * 2
_DISAGREE = 0.02


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would find them, but linear in runs that no at sign follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; offsets in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 20 and int(p) <= 255 for p in _trimmed(m[0]))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _trimmed(ip: str) -> list[str]:
    return [p.lstrip("0") or "0" for p in ip.split(".")]


@dataclass
class Nodes:
    """Candidate tokens of a batch of documents."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    base: np.ndarray  #: kind of the base span that covers the token, OTHER if none
    chain: np.ndarray  #: pairs of neighbours
    skip: np.ndarray  #: pairs of a token and its class, of two tokens or more; classes are numbered on from the tokens
    class_shape: np.ndarray  #: of a class, that of its first token

    def labels(self) -> np.ndarray:
        """Of tokens and classes as far as base spans tell: a class has the least kind among its tokens, a hidden token that of its classes."""
        n, m = len(self.doc), len(self.class_shape)
        out = np.concatenate([self.base, np.full(m, OTHER)])
        np.minimum.at(out, self.skip[:, 1], self.base[self.skip[:, 0]])
        hidden = self.base[self.skip[:, 0]] == OTHER
        np.minimum.at(out, self.skip[hidden, 0], out[self.skip[hidden, 1]])
        return out


def _shape(token: str) -> int:
    digits = sum("0" <= c <= "9" for c in token)
    return ((0 if digits == 0 else 1 if digits < 5 else 2 if digits < 10 else 3) * 8) + 4 * ("@" in token) + 2 * (token.count(".") >= 2) + any(c.isalpha() for c in token)


def _names(token: str) -> list[str]:
    """What a token has in common with equal and similar ones."""
    plain = token.strip(_EDGE).lower()
    digits = "".join(c for c in plain if "0" <= c <= "9")
    out = ["=" + plain] if plain else []
    if len(digits) >= 7:
        out.append("#" + digits)
    if "@" in plain:
        out.append("@" + plain.partition("@")[0])
    elif any(c.isalpha() for c in plain) and digits:
        out.append("@" + plain)
    return out


def nodes(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Nodes:
    doc, start, end, shape, base, chain, members, class_shape = [], [], [], [], [], [], [], []
    for d, (text, own) in enumerate(zip(texts, spans)):
        if not ("@" in text or _DIGIT.search(text)):
            continue
        cover = sorted((a, b, k) for k, a, b in own)
        i, last, seen = 0, -2, {}
        for n, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            if "@" not in token and not _DIGIT.search(token):
                continue
            while i < len(cover) and cover[i][1] <= m.start():
                i += 1
            kind = next((k for a, b, k in cover[i : i + 4] if a < m.end() and b > m.start()), OTHER)
            v = len(doc)
            doc.append(d)
            start.append(m.start())
            end.append(m.end())
            shape.append(_shape(token))
            base.append(kind)
            if n == last + 1:
                chain.append((v - 1, v))
            last = n
            for name in _names(token):
                seen.setdefault(name, []).append(v)
        for name, own_tokens in seen.items():
            if len(own_tokens) > 1:
                members += [(v, len(class_shape)) for v in own_tokens]
                class_shape.append(shape[own_tokens[0]])
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Nodes(*(np.array(x, np.int64) for x in (doc, start, end, shape, base)), pairs(chain), pairs(members) + [0, len(doc)], np.array(class_shape, np.int64))


@dataclass(frozen=True)
class Field:
    """Log potentials: of shape and label, of the labels of neighbours, and of those of similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    evidence: float = 8.0
    most_rounds: int = 200
    damping: float = 0.5
    tolerance: float = 1e-4

    def beliefs(self, x: Nodes) -> np.ndarray:
        """Marginals of tokens, then classes, after damped sum-product messages that change by ``tolerance`` at most."""
        n, m = len(x.doc), len(x.class_shape)
        # A token of a class leaves its shape's potential to the class.
        alone = np.ones(n, bool)
        alone[x.skip[:, 0]] = False
        local = np.concatenate([self.unary[x.shape] * alone[:, None], self.unary[x.class_shape]])
        seen = np.flatnonzero(x.base < OTHER)
        local[seen, x.base[seen]] += self.evidence
        edges = np.concatenate([x.chain, x.skip])
        kind = np.repeat([0, 1], [len(x.chain), len(x.skip)])
        u, v = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.stack([self.chain, self.skip])[np.concatenate([kind, kind])]
        tables[len(edges) :] = tables[len(edges) :].transpose(0, 2, 1)
        turn = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(u), LABELS))
        for _ in range(self.most_rounds if len(u) else 0):
            total = local + _gathered(v, message, n + m)
            new = _logsum((total[u] - message[turn])[:, :, None] + tables, 1)
            new -= _logsum(new, 1)[:, None]
            change = float(np.abs(new - message).max())
            message = self.damping * message + (1 - self.damping) * new
            if change < self.tolerance:
                break
        total = local + _gathered(v, message, n + m)
        return np.exp(total - _logsum(total, 1)[:, None])


def _gathered(v: np.ndarray, message: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(v, message[:, k], minlength=n) for k in range(LABELS)], axis=1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(docs: DataFrame, max_train_docs: int = 5000) -> Field:
    """Potentials from how labels go with shapes, neighbours and classes.

    Counted over ``max_train_docs`` distinct texts, those of the least hash:
    that parameter bounds the sample.  A class counts
    once however many tokens it has, a hidden token has the label of its class;
    counts are smoothed by one, those of token and class by one pair that
    agrees and ``_DISAGREE`` that don't.
    """
    rows = docs.select("text", F.lit(0).alias("_all")).where("text is not null")
    sample = distinct_texts(rows, max_train_docs, "_all").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = nodes(texts, [base_spans(t) for t in texts])
            label = x.labels()
            alone = np.setdiff1d(np.arange(len(x.doc)), x.skip[:, 0])
            once = np.concatenate([alone, len(x.doc) + np.arange(len(x.class_shape))])
            a, b, c = np.concatenate([x.shape, x.class_shape])[once] * LABELS + label[once], *(label[e[:, 0]] * LABELS + label[e[:, 1]] for e in (x.chain, x.skip))
            for what, values in enumerate((a, b, c)):
                cell, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), what), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["what", "cell", "n"])

    counts = [np.ones((_SHAPES, LABELS)), np.ones((LABELS, LABELS)), np.full((LABELS, LABELS), _DISAGREE) + np.eye(LABELS)]
    for r in sample.mapInArrow(run, "what int, cell int, n long").groupBy("what", "cell").agg(F.sum("n").alias("n")).collect():  # at most a few hundred cells
        counts[r["what"]][divmod(r["cell"], LABELS)] += r["n"]
    unary = np.log(counts[0] / counts[0].sum(axis=1, keepdims=True))
    # Of neighbours, how much likelier a pair is than by chance; of token and class, the share that agrees, whatever the label's frequency.
    chain, skip = (c + c.T for c in counts[1:])
    each, own = chain.sum(axis=1) / chain.sum(), np.sqrt(skip.sum(axis=1))
    return Field(unary, np.log(chain / chain.sum()) - np.log(np.outer(each, each)), np.log(skip / np.outer(own, own)))


def _whole(kind: int, text: str) -> bool:
    """Whether a stretch of text could name its kind by itself."""
    digits = sum("0" <= c <= "9" for c in text)
    return (any(c.isalpha() for c in text), text.count(".") == 3, digits >= 12, digits >= 7)[kind]


def added_spans(texts: list[str], spans: list[list[tuple[int, int, int]]], field: Field, least: float = 0.6) -> list[list[tuple[int, int, int]]]:
    """Spans outside the base ones, of tokens whose label has a marginal of ``least`` or more.

    Similar tokens must lead from each such token to one of a base span of its
    label.  Neighbours of one kind join; the whole must be enough to name it:
    7 digits for a phone, 12 for a card, four parts for an ip, a letter for an
    email.
    """
    x = nodes(texts, spans)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(x.doc):
        return out
    belief, n = field.beliefs(x), len(x.doc)
    label = np.where(belief.max(axis=1) >= least, belief.argmax(axis=1), OTHER)
    label[:n] = np.where(x.base < OTHER, x.base, label[:n])
    # Tokens and classes of one label that hang together; those with a base span in them count.
    root = list(range(len(label)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for u, v in x.skip[(label[x.skip[:, 0]] == label[x.skip[:, 1]]) & (label[x.skip[:, 0]] < OTHER)].tolist():
        root[find(u)] = find(v)
    named = {find(v) for v in np.flatnonzero(x.base < OTHER).tolist()}
    held = np.array([label[v] < OTHER and find(v) in named for v in range(n)], bool)
    joins, before = set(map(tuple, x.chain.tolist())), None
    for v in np.flatnonzero(held & (x.base == OTHER)).tolist():
        d, k, a, b = int(x.doc[v]), int(label[v]), int(x.start[v]), int(x.end[v])
        while a < b and texts[d][a] in _EDGE:
            a += 1
        while a < b and texts[d][b - 1] in _EDGE:
            b -= 1
        own = out[d]
        if before == v - 1 and (v - 1, v) in joins and own and own[-1][0] == k:
            own[-1] = (k, own[-1][1], b)
        elif a < b:
            own.append((k, a, b))
        before = v
    return [[(k, a, b) for k, a, b in own if _whole(k, texts[d][a:b])] for d, own in enumerate(out)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def report(docs: DataFrame, field: Field) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``, a row for a row.

    The counts and the digest are of the base spans; spans has these and the
    field's.  A null or empty text has none.  Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            count = lambda k: pa.array([sum(s[0] == k for s in row) for row in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(count(k) for k in range(OTHER)), pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string()),
                 pa.array([joined(a + b) for a, b in zip(base, more)], pa.string()), pa.array([len(row) for row in more], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
