"""Terminal operators of a query: projection, aggregation, grouping, clustering, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodegraph import schema as S
from lodegraph.functions import scalar
from lodegraph.functions.fields import Fields
from lodegraph.plans.plan import OUT, direction as checked

OPS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _op(name: str):  # noqa: ANN202
    if name not in OPS:
        raise S.GraphError(f"unknown aggregate {name!r}")
    return OPS[name]


class Relational:
    """Mixed into GraphQuery; ``to_df`` and ``graph`` come from there."""

    def _fields(self) -> Fields:
        return Fields(self.graph.nodes)

    def count(self) -> int:
        """Rows after all stages, page included."""
        return self.to_df().count()

    def pluck(self, *names: str) -> DataFrame:
        """id, type and the fields, null where missing."""
        fields = self._fields()
        return self.to_df().select("id", "type", *(fields.raw(n).alias(n.removeprefix("data.")) for n in names))

    def aggregate(self, name: str, op: str) -> DataFrame:
        """One row ``(value, count)`` over the finite numbers of a field; both 0 where there are none."""
        n = self._fields().number(name)
        return self.to_df().select(n.alias("n")).agg(F.coalesce(_op(op)("n").cast("double"), F.lit(0.0)).alias("value"), F.count("n").alias("count"))

    def group_aggregate(self, name: str, op: str, by: str) -> DataFrame:
        """``(key, value, count)``: ``count`` counts any non-null value, other operations finite numbers; groups without one are left out."""
        fields = self._fields()
        key = scalar.group_key(F.col("type"), "string") if by == "type" else fields.key(by)
        return self._grouped(self.to_df().withColumn("key", key), fields, name, op)

    def _grouped(self, keyed: DataFrame, fields: Fields, name: str, op: str) -> DataFrame:
        value = F.when(fields.present(name), 1.0) if op == "count" else fields.number(name)
        return keyed.select("key", value.alias("n")).where("n is not null").groupBy("key").agg(_op(op)("n").cast("double").alias("value"), F.count("n").alias("count"))

    @staticmethod
    def having(groups: DataFrame, predicate: Column) -> DataFrame:
        return groups.where(predicate)

    def group_by_vector(self, centroids: dict[str, list[float]], name: str, op: str, threshold: float = 0.0) -> DataFrame:
        """group_aggregate by the centroid of greatest cosine above ``threshold`` (of equal ones the first given), else 'null'; nodes without a vector are left out."""
        best = reduce(_better, ((F.lit(k), scalar.cosine_to(F.col("vector"), v)) for k, v in centroids.items()), None) if centroids else None
        key = F.lit("null") if best is None else F.when(best[1] > threshold, best[0]).otherwise("null")
        return self._grouped(self.to_df().where("vector is not null").withColumn("key", key), self._fields(), name, op)

    def unique_keys(self, name: str) -> DataFrame:
        """Distinct values of a field over all nodes of the graph, whatever the filters."""
        fields = self._fields()
        return self.graph.nodes.where(fields.raw(name).isNotNull()).select(fields.text(name).alias("value")).distinct()

    def collect_neighbours(self, edge_type: str, direction: str = OUT, predicate: Column | None = None) -> DataFrame:
        """Distinct nodes one edge away from the result; ``predicate`` on node columns applies to them."""
        near, far = ("source", "target") if checked(direction) == OUT else ("target", "source")
        links = self.graph.edges.where(F.col("type") == edge_type)
        ids = links.join(self.to_df().select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id"))
        out = self.graph.nodes.join(ids, "id", "left_semi")
        return out if predicate is None else out.where(predicate)


def _better(best: tuple[Column, Column] | None, new: tuple[Column, Column]) -> tuple[Column, Column]:
    if best is None:
        return new
    return F.when(new[1] > best[1], new[0]).otherwise(best[0]), F.greatest(best[1], new[1])
