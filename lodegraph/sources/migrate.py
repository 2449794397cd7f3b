"""Data migrations: contiguous steps of one version each, over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodegraph import schema as S
from lodegraph.operators.graph import Graph


@dataclass(frozen=True)
class Step:
    """From ``version`` to the next; ``nodes`` and ``edges`` map a DataFrame, or with ``batches`` a pandas batch."""

    version: int
    nodes: Callable | None = None
    edges: Callable | None = None
    batches: bool = False


def migrate(graph: Graph, steps: list[Step], version: int, to: int, dry_run: bool = False, progress: Callable[[int], None] | None = None) -> tuple[Graph, DataFrame]:
    """The graph at version ``to``, and a report ``(version, nodes, edges)`` of rows changed by each step.

    Steps must be contiguous, and none may change an id, a node's type, or an
    edge's ends: ConflictError.  A dry run returns the graph as it was.
    """
    own = {s.version: s for s in steps}
    if len(own) < len(steps) or any(v not in own for v in range(version, to)):
        raise S.GraphError("the steps are not contiguous")
    now, report = graph, []
    for v in range(version, to):
        new = Graph(_mapped(now.nodes, own[v].nodes, own[v].batches), _mapped(now.edges, own[v].edges, own[v].batches))
        _same(now.nodes, new.nodes, ["id", "type"])
        _same(now.edges, new.edges, ["id", "source", "type", "target"])
        report.append((v + 1, new.nodes.count() if own[v].nodes else 0, new.edges.count() if own[v].edges else 0))
        now = new
        if progress:
            progress(v + 1)
    spark = graph.nodes.sparkSession
    return (graph if dry_run else now), spark.createDataFrame(report, "version int, nodes bigint, edges bigint")


def _mapped(df: DataFrame, f: Callable | None, batches: bool) -> DataFrame:
    if f is None:
        return df
    if not batches:
        return f(df)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield f(part)

    return df.mapInPandas(run, df.schema)


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> None:
    if a is b:
        return
    lost = a.select(columns).exceptAll(b.select(columns)).unionByName(b.select(columns).exceptAll(a.select(columns)))
    if not lost.isEmpty():
        raise S.Conflict("a migration changed identities")


def in_batches(nodes: DataFrame, size: int, after: str | None = None) -> Iterator[DataFrame]:
    """Batches of ``size`` rows in the order of id, from after the id given: for resuming."""
    while True:
        rest = nodes if after is None else nodes.where(F.col("id") > after)
        part = rest.orderBy("id").limit(size)
        last = part.agg(F.max("id").alias("m")).first()["m"]
        if last is None:
            return
        yield part
        after = last


def renamed(column: str, new: str) -> Callable[[DataFrame], DataFrame]:
    """A step that renames a field of a struct ``data``."""
    return lambda df: df.withColumn("data", F.col("data").withField(new, F.col("data")[column]).dropFields(column))


__all__ = ["Step", "in_batches", "migrate", "renamed", "replace"]
