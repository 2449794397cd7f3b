"""Bounded breadth-first traversal and walks, one join a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodegraph.plans.plan import OUT, Traversal
from lodegraph.schema import ResourceLimit

#: Hops that stay one lazy plan; deeper traversals cut their lineage at each further hop.
LAZY_HOPS = 3


def links(edges: DataFrame, edge_types: list[str] | None, direction: str = OUT) -> DataFrame:
    """``(from_id, to_id)`` along edges of the types (any where None), one for each edge."""
    own = edges if edge_types is None else edges.where(F.col("type").isin(*edge_types))
    a, b = ("source", "target") if direction == OUT else ("target", "source")
    return own.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))


def step(edges: DataFrame, edge_types: list[str] | None, direction: str = OUT) -> DataFrame:
    """``links``, each pair once."""
    return links(edges, edge_types, direction).distinct()


def reach(seeds: DataFrame, edges: DataFrame, edge_types: list[str] | None, depth: int, direction: str = OUT) -> DataFrame:
    """``seeds(id)`` -> ``(id, hop)``: every id within ``depth`` hops, once, at its least hop; seeds have hop 0.

    Ids without a node are walked through like any other.
    """
    ways = links(edges, edge_types, direction)
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("id")
    for hop in range(1, depth + 1):
        new = frontier.join(ways, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        if hop > LAZY_HOPS:
            new = _cut(new)
            if new.isEmpty():
                break
        seen = seen.unionByName(new.withColumn("hop", F.lit(hop)))
        frontier = new
    return seen


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder of ``spark.checkpoint.dir``; on a local session without one, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="lodegraph-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def traverse(seeds: DataFrame, edges: DataFrame, steps: tuple[Traversal, ...]) -> DataFrame:
    """``(id, hop)`` after chained traversals: what one step reaches, seeds included, seeds the next."""
    out = seeds.select("id").withColumn("hop", F.lit(0))
    for i, t in enumerate(steps):
        found = reach(out, edges, [t.edge_type], t.depth, t.direction)
        out = found if i == 0 else found.withColumnRenamed("hop", "last_hop").join(out, "id", "left").select("id", F.coalesce("hop", F.col("last_hop")).alias("hop"))
    return out


def walk(start: str, edges: DataFrame, edge_type: str, ancestors: bool, max_steps: int = 10_000) -> list[str]:
    """Follows the first edge (by ``_seq``) from node to node until there is none or a node comes again.

    Ancestors come root first, with ``start`` last; descendants begin with
    ``start``.  Each step is one lookup, so a walk costs as many small jobs as
    it is long; beyond ``max_steps`` it raises ResourceLimit.
    """
    near, far = ("target", "source") if ancestors else ("source", "target")
    own = edges.where(F.col("type") == edge_type).groupBy(near).agg(F.min_by(far, "_seq").alias("next")).cache()
    path, at = [start], start
    try:
        for _ in range(max_steps):
            row = own.where(F.col(near) == at).select("next").first()
            if row is None or row["next"] in path:
                break
            at = row["next"]
            path.append(at)
        else:
            raise ResourceLimit(f"a walk of more than {max_steps} steps")
    finally:
        own.unpersist()
    return path[::-1] if ancestors else path
