"""Secret scans judged by corpus-wide ownership.

Patterns find candidates.  Each candidate's hash is then aggregated over the
whole corpus by distinct repository and distinct owner: a value that many
owners have is a copied example, one that stays with its owner looks live.
Column names that begin with ``_ll_`` are reserved.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lodegraph.llm.scratch import written

# The base kinds in their order, their patterns and least lengths.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST = 12

_WORDISH = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_FOUND = "array<struct<kind:int,start:int,end:int,hash:binary>>"


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, value)`` in the order of start, then kind; offsets in code points."""
    out = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def entropy_spans(text: str, taken: list[tuple[int, int, int, str]], least_bits: float) -> list[tuple[int, int, int, str]]:
    """Long runs of mixed letters and digits with ``least_bits`` of entropy a character that no span of ``taken``, in the order of starts, touches."""
    covered: list[list[int]] = []  # the union of the spans taken
    for _, a, b, _ in taken:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, at = [], 0
    for m in _WORDISH.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        s = m[0]
        if not (at < len(covered) and covered[at][0] < m.end()) and any(c.isdigit() for c in s) and s.lower() != s != s.upper() and _entropy(s) >= least_bits:
            out.append((3, m.start(), m.end(), s))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in sorted(spans, key=lambda s: (s[1], s[0])))


def candidates(docs: DataFrame, keep: list[str] | None = None, found: str = "_ll_found", least_bits: float = 3.7) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` and one of the candidate spans of ``text``: kind (index into KINDS), start, end, SHA-256 of the value."""
    keep = docs.columns if keep is None else keep
    names, at = docs.columns, docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(at):
                text = x.as_py() or ""
                base = base_spans(text)
                rows.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).digest()} for k, a, b, v in base + entropy_spans(text, base, least_bits)])
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(rows, kind)], [*keep, found])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(f"{found} {_FOUND}").fields]))


def ownership(found: DataFrame) -> DataFrame:
    """``found(hash, repo, owner)`` -> ``(hash, repos, owners)``, the numbers of distinct ones; null is one of its own."""
    pairs = found.select("hash", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    return pairs.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def _judged(marked: DataFrame, max_owners: int) -> DataFrame:
    """``marked(_ll_row, _ll_repo, _ll_owner, _ll_found)`` -> ``(_ll_row, _ll_spans)`` for the rows that have spans."""
    each = marked.select("_ll_row", F.col("_ll_repo").alias("repo"), F.col("_ll_owner").alias("owner"), F.explode("_ll_found").alias("f")).select("_ll_row", "repo", "owner", "f.*")
    stats = written(ownership(each), "ownership")
    judged = each.join(stats, "hash").withColumn("live", F.col("owners") <= max_owners).where(f"kind < {len(BASE)} or live")
    return written(judged.groupBy("_ll_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "repos", "owners"))).alias("_ll_spans")), "spans")


def scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, max_owners: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs``, columns ``keep`` (all), with ``_ll_spans``: array of (start, kind, end, live, repos, owners), null where there are none.

    ``repo`` and ``owner`` say where a document comes from (both default to
    ``source``).  ``live`` is true where ``max_owners`` owners or fewer have
    the value; ``repos`` and ``owners`` are how many have it.  Entropy candidates come back only where they are live; base
    ones always.  A null or empty text has no spans.
    """
    repo, owner = (F.col("source") if c is None else c for c in (repo, owner))
    keep = docs.columns if keep is None else keep
    origin = docs.withColumns({"_ll_repo": repo.cast("string"), "_ll_owner": owner.cast("string")})
    marked = written(candidates(origin, [*keep, "_ll_repo", "_ll_owner"]).withColumn("_ll_row", F.monotonically_increasing_id()), "secrets")
    spans = _judged(marked, max_owners)
    hit = marked.where(F.size("_ll_found") > 0).join(spans, "_ll_row", "left").select(*keep, "_ll_spans")
    return hit.unionByName(marked.where(F.size("_ll_found") == 0).select(*keep, F.lit(None).cast(spans.schema["_ll_spans"].dataType).alias("_ll_spans")))


def report(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """``docs(doc_id, text, source)`` -> counts and digest of the base spans, all spans, and how many look live or copied.

    One row for each row given, repeated or null doc_id included; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["kind"], s["start"], s["end"], s["live"]) for s in row or []] for row in batch.column(1).to_pylist()]
            base = [[s for s in row if s[0] < len(BASE)] for row in spans]
            count = lambda k: pa.array([sum(s[0] == k for s in row) for row in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string()), pa.array([joined(row) for row in spans], pa.string()),
                 pa.array([sum(s[3] for s in row) for row in spans], pa.int64()), pa.array([sum(not s[3] for s in row) for row in spans], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return scan(slim, max_owners=max_owners, keep=["doc_id"]).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_copied long")


def redacted(docs: DataFrame, max_owners: int = 2, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span of ``text`` replaced by ``mark``, and ``n_chars`` counted anew where there is one."""
    found = scan(docs, max_owners=max_owners)  # each read below is of a written table

    @F.pandas_udf("string")
    def without(texts, spans):  # noqa: ANN001, ANN202
        out = []
        for text, row in zip(texts, spans):
            parts, at = [], 0
            for s in row:
                if s["live"] and s["end"] > at:
                    parts += [text[at : max(at, s["start"])], mark]
                    at = s["end"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    live = F.coalesce(F.exists("_ll_spans", lambda s: s["live"]), F.lit(False))
    hit = found.where(live).withColumn("text", without("text", "_ll_spans"))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.where(~live).select(docs.columns).unionByName(hit.select(docs.columns))
