"""A property graph: a DataFrame of nodes and one of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lodegraph import schema as S


@dataclass(frozen=True)
class Graph:
    """Nodes (``schema.NODE_COLUMNS`` and ``data``) and edges (``schema.EDGE_COLUMNS`` and, if any, ``data``).

    Both are plain DataFrames, so a Graph is a snapshot: operators return a
    new one.  ``_seq`` numbers rows in the order of insertion and breaks ties.
    """

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Adds the columns that are missing, as nulls (revision 0, ownership reference, ``_seq`` by id)."""
        for name, kind in S.NODE_COLUMNS.items():
            if name not in nodes.columns:
                nodes = nodes.withColumn(name, F.lit(0 if name == "revision" else None).cast(kind) if name != "_seq" else F.xxhash64("id"))
        for name, kind in S.EDGE_COLUMNS.items():
            if name not in edges.columns:
                default = {"revision": F.lit(0).cast("long"), "ownership": F.lit("reference"), "_seq": F.xxhash64("id") if "id" in edges.columns else F.xxhash64("source", "type", "target"), "id": F.concat_ws("::", "source", "type", "target")}
                edges = edges.withColumn(name, default.get(name, F.lit(None).cast(kind)))
        if "data" not in nodes.columns:
            nodes = nodes.withColumn("data", F.struct(F.lit(None).cast("string").alias("_")))
        return cls(nodes, edges)

    def query(self):  # noqa: ANN201
        from lodegraph.operators.query import GraphQuery

        return GraphQuery(self)

    def of_type(self, type_: str, ordered: bool = False) -> DataFrame:
        out = self.nodes.where(F.col("type") == type_)
        return out.orderBy("_seq") if ordered else out

    def count_of_type(self, type_: str) -> int:
        return self.of_type(type_).count()

    def out_edges(self, source: str, type_: str | None = None) -> DataFrame:
        own = self.edges.where(F.col("source") == source)
        return own if type_ is None else own.where(F.col("type") == type_)

    def edges_by(self, ids: DataFrame, end: str = "source", type_: str | None = None) -> DataFrame:
        """Edges whose ``end`` is among ``ids(id)``."""
        own = self.edges if type_ is None else self.edges.where(F.col("type") == type_)
        return own.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")

    def targets(self, source: str, type_: str) -> DataFrame:
        """One row for each edge, so parallel edges repeat."""
        return self.out_edges(source, type_).orderBy("_seq").select(F.col("target").alias("id"))

    def sources(self, target: str, type_: str) -> DataFrame:
        return self.edges.where((F.col("target") == target) & (F.col("type") == type_)).select(F.col("source").alias("id")).distinct()

    def stats(self) -> DataFrame:
        """One row: numbers of nodes, edges, vectors, activated nodes, and node types."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.count("vector").alias("vectors"), F.count("activation").alias("activated"), F.count_distinct("type").alias("types"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edges")))  # one row each

    def verify(self) -> DataFrame:
        """``(problem, n)`` of what must not be: repeated ids, dangling edges, vectors of several sizes, non-finite numbers."""
        node_ids = self.nodes.select("id")
        repeats = lambda df, what: df.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(what).alias("problem"), "n")
        dangling = [self.edges.join(node_ids.withColumnRenamed("id", end), end, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"edge {end} without a node").alias("problem"), "n") for end in ("source", "target")]
        sizes = self.nodes.where("vector is not null").agg(F.greatest(F.count_distinct(F.size("vector")) - 1, F.lit(0)).alias("n")).select(F.lit("further vector sizes").alias("problem"), "n")
        odd = self.nodes.where(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).agg(F.count("*").alias("n")).select(F.lit("vectors with non-finite numbers").alias("problem"), "n")
        out = repeats(self.nodes, "repeated node id").unionByName(repeats(self.edges, "repeated edge id"))
        for df in (*dangling, sizes, odd):
            out = out.unionByName(df)
        return out.where("n > 0")
