"""The fluent query builder: each call adds to a Plan, and the plan becomes DataFrame operations at the end."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodegraph import schema as S
from lodegraph.functions import scalar
from lodegraph.functions.fields import Fields
from lodegraph.operators import traverse
from lodegraph.operators.graph import Graph
from lodegraph.operators.relational import Relational
from lodegraph.plans import plan as P


class GraphQuery(Relational):
    """Immutable: every method returns a new query.

    Order of application: types, attributes, edge filter, semi-joins,
    traversal, activation, order, similarity, offset, limit.
    """

    def __init__(self, graph: Graph, plan: P.Plan = P.Plan(), now: int | Column | None = None, on_metrics: Callable[[dict], None] | None = None) -> None:
        self.graph, self.plan, self._now, self._on_metrics = graph, plan, now, on_metrics

    def _with(self, **changes) -> GraphQuery:  # noqa: ANN003
        return GraphQuery(self.graph, self.plan.but(**changes), self._now, self._on_metrics)

    @classmethod
    def from_plan(cls, graph: Graph, document: dict) -> GraphQuery:
        return cls(graph, P.from_json(document))

    # Filters

    def where(self, name: str, value: object) -> GraphQuery:
        """Strict equality; ``type`` is the node's type.  A later call for the same field replaces this one."""
        return self._replaced(P.Filter(name, "eq", value))

    where_attribute = where

    def where_attribute_range(self, name: str, above: float | None = None, below: float | None = None) -> GraphQuery:
        """Both bounds are exclusive; what isn't a finite number doesn't match."""
        return self._replaced(P.range_filter(name, above, below))

    def _replaced(self, new: P.Filter) -> GraphQuery:
        return self._with(attributes=(*(f for f in self.plan.attributes if (f.field, f.operator) != (new.field, new.operator)), new))

    def where_node_type(self, *types: str) -> GraphQuery:
        """Any of the types; none given matches nothing."""
        return self._with(node_types=types)

    def where_edge(self, type_: str, target: str | None = None) -> GraphQuery:
        """Has an outgoing edge of the type (to the target)."""
        old = self.plan.edge_filter or P.EdgeFilter()
        return self._with(edge_filter=P.EdgeFilter(type_, target, old.source))

    def where_edge_source(self, source: str) -> GraphQuery:
        """Is the target of an edge from the source, of where_edge's type if that is set; both filters apply then."""
        old = self.plan.edge_filter or P.EdgeFilter()
        return self._with(edge_filter=P.EdgeFilter(old.type, old.target, source))

    def where_activated(self, above: float, now: int | Column | None = None) -> GraphQuery:
        """The decayed score is ``above`` or more."""
        return self.at(now)._with(activated_above=P.finite(above, "above"))

    def join(self, edge_type: str, direction: str = P.OUT, predicate: Column | None = None) -> GraphQuery:
        """Keeps nodes with a neighbour (an existing node) along such an edge, for which ``predicate`` on node columns holds."""
        return self._with(joins=(*self.plan.joins, P.Join(edge_type, P.direction(direction), predicate)))

    def traverse(self, edge_type: str, depth: int, direction: str = P.OUT) -> GraphQuery:
        return self._with(traversals=(*self.plan.traversals, P.Traversal(edge_type, P.whole(depth, "depth"), P.direction(direction))))

    # Order and page

    def order_by(self, name: str, direction: str = "asc") -> GraphQuery:
        """Numeric; what is missing or no number counts as 0."""
        return self._with(order=(name, direction))

    def order_by_activation(self, direction: str = "desc", now: int | Column | None = None) -> GraphQuery:
        return self.at(now)._with(activation_order=direction)

    def similar_to(self, vector: list[float], threshold: float = 0.0, top_k: int | None = None, engine: str = "exact") -> GraphQuery:
        """Keeps nodes with a vector at ``threshold`` or more, best first; overrides other orders, which break its ties."""
        if top_k is not None:
            P.whole(top_k, "top_k")
        return self._with(similarity=P.Similarity(tuple(P.finite(x, "vector") for x in vector), P.finite(threshold, "threshold"), top_k, engine))

    def offset(self, n: int) -> GraphQuery:
        return self._with(offset=P.whole(n, "offset"))

    def limit(self, n: int) -> GraphQuery:
        return self._with(limit=P.whole(n, "limit"))

    def at(self, now: int | Column | None) -> GraphQuery:
        """The time at which activation is read."""
        return self if now is None else GraphQuery(self.graph, self.plan, now, self._on_metrics)

    def with_limits(self, **limits: int) -> GraphQuery:
        """max_traversal_depth, max_nodes_visited (by traversal), max_results (rows returned)."""
        if unknown := set(limits) - {"max_traversal_depth", "max_nodes_visited", "max_results"}:
            raise S.GraphError(f"unknown limits {sorted(unknown)}")
        return self._with(limits={**self.plan.limits, **{k: P.whole(v, k) for k, v in limits.items()}})

    def on_metrics(self, call: Callable[[dict], None]) -> GraphQuery:
        return GraphQuery(self.graph, self.plan, self._now, call)

    # Evaluation

    def _filters(self, fields: Fields) -> list[Column]:
        out = []
        if self.plan.node_types is not None:
            out.append(F.col("type").isin(*self.plan.node_types) if self.plan.node_types else F.lit(False))
        for f in self.plan.attributes:
            if f.operator == "eq":
                out.append(F.col("type") == F.lit(f.value) if f.field == "type" else fields.equals(f.field, f.value))
            else:
                n = fields.number(f.field)
                out += [n > f.above] * (f.above is not None) + [n < f.below] * (f.below is not None)
        return out

    def _matched(self) -> DataFrame:
        """Source selection, filters, edge filter and semi-joins."""
        out = reduce(lambda df, c: df.where(c), self._filters(Fields(self.graph.nodes)), self.graph.nodes)
        edges, e = self.graph.edges, self.plan.edge_filter
        if e and e.type is not None:
            own = edges.where(F.col("type") == e.type)
            own = own if e.target is None else own.where(F.col("target") == e.target)
            out = out.join(own.select(F.col("source").alias("id")), "id", "left_semi")
        if e and e.source is not None:
            own = edges.where(F.col("source") == e.source)
            own = own if e.type is None else own.where(F.col("type") == e.type)
            out = out.join(own.select(F.col("target").alias("id")), "id", "left_semi")
        for j in self.plan.joins:
            near, far = ("source", "target") if j.direction == P.OUT else ("target", "source")
            others = self.graph.nodes if j.predicate is None else self.graph.nodes.where(j.predicate)
            own = edges.where(F.col("type") == j.edge_type).select(F.col(near).alias("id"), F.col(far).alias("_other")).join(others.select(F.col("id").alias("_other")), "_other", "left_semi")
            out = out.join(own.select("id"), "id", "left_semi")
        return out

    def _ranked(self) -> tuple[DataFrame, list[Column]]:
        """All stages before the page, and the order that they ask for."""
        limits = self.plan.limits
        out = self._matched()
        first: list[Column] = []
        if self.plan.traversals:
            if sum(t.depth for t in self.plan.traversals) > limits.get("max_traversal_depth", 1 << 62):
                raise S.ResourceLimit("max_traversal_depth")
            found = traverse.traverse(out, self.graph.edges, self.plan.traversals)
            if "max_nodes_visited" in limits and found.limit(limits["max_nodes_visited"] + 1).count() > limits["max_nodes_visited"]:
                raise S.ResourceLimit("max_nodes_visited")
            out = self.graph.nodes.join(found.withColumnRenamed("hop", "_hop"), "id")
            first = [F.col("_hop")]
        order = [*first, F.col("_seq"), F.col("id")]
        if self.plan.order:
            name, way = self.plan.order
            value = F.coalesce(Fields(self.graph.nodes).number(name), F.lit(0.0))
            order = [value.desc() if way == "desc" else value.asc(), *order]
        if self.plan.activated_above is not None or self.plan.activation_order:
            if self._now is None:
                raise S.GraphError("activation needs 'now'")
            score = scalar.activation_score(F.col("activation"), self._now, scalar.class_half_life(F.col("memory_class"), 0, S.SCORE_HALF_LIFE))
            if self.plan.activated_above is not None:
                out = out.where(score >= self.plan.activated_above)
            if self.plan.activation_order:
                order = [score.asc() if self.plan.activation_order == "asc" else score.desc(), *order]
        if (s := self.plan.similarity) is not None:
            if s.engine != "exact":
                from lodegraph.operators.vector import approximate_candidates

                out = approximate_candidates(out, list(s.vector), s.top_k)
            out = out.withColumn("_similarity", scalar.cosine_to(F.col("vector"), list(s.vector))).where(F.col("_similarity") >= s.threshold)
            order = [F.col("_similarity").desc(), *order]
        return out, order

    def to_df(self) -> DataFrame:
        """The node rows, ordered where an order, a page or a similarity asks for it."""
        out, order = self._ranked()
        p = self.plan
        top = p.similarity.top_k if p.similarity else None
        needs = p.order or p.activation_order or p.similarity or p.offset is not None or p.limit is not None
        if needs:
            out = out.orderBy(*order)
        if top is not None:
            out = out.limit(top)
        if p.offset:
            out = out.offset(p.offset)
        if p.limit is not None:
            out = out.limit(p.limit)
        if "max_results" in p.limits and out.limit(p.limits["max_results"] + 1).count() > p.limits["max_results"]:
            raise S.ResourceLimit("max_results")
        return out.drop("_hop")

    def to_list(self) -> list:
        """Rows; the caller's choice to bring them to the driver."""
        began = time.monotonic()
        rows = self.to_df().collect()
        if self._on_metrics:
            self._on_metrics({"rows": len(rows), "milliseconds": (time.monotonic() - began) * 1000, "stages": self.plan.stages()})
        return rows

    def first(self):  # noqa: ANN201
        rows = self.limit(min(1, self.plan.limit if self.plan.limit is not None else 1)).to_df().take(1)
        return rows[0] if rows else None

    def ids(self) -> DataFrame:
        return self.to_df().select("id")

    def explain(self) -> dict:
        """Stages, usable equality filters, an estimate that each halves twice, and Spark's plan."""
        equal = [f.field for f in self.plan.attributes if f.operator == "eq"]
        return {"index": equal[0] if equal else None, "indexes": equal, "stages": self.plan.stages(), "estimated_cost": 0.25 ** len(equal), "plan": self.to_df()._jdf.queryExecution().toString()}
