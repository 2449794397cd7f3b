"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each
step is one aggregation and one join on the node; labels never leave Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodegraph.llm.scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points each node's larger (or smaller) neighbours at the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    joined = both.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(u, v)`` of long ids -> ``(node, component)`` for every node that has an edge; component is its least node.

    Self-loops, repeated edges and rows with a null end are ignored.  No edges: no rows.
    Raises if it hasn't converged after ``max_rounds`` (it takes a logarithm of the size).
    """
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = written(_star(written(_star(now, True), "large"), False), "small")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if new == mark or not new["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"no convergence in {max_rounds} rounds")
