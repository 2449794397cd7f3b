"""Mutations: each takes a graph and returns a new one, so a failed check leaves the old one as it was."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lodegraph import schema as S
from lodegraph.functions.embedding import feature_hash
from lodegraph.operators import activation
from lodegraph.operators.graph import Graph
from lodegraph.operators.traverse import _cut


def _none(violations: DataFrame, error: type[S.GraphError]) -> None:
    row = violations.limit(1).collect()
    if row:
        raise error(str(row[0].asDict(recursive=True)))


def last_of_each(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of rows that repeat ``key`` the last, as the rows are read; adds their place ``_at``.  The others never leave their task."""
    names = [c for c in rows.columns if c != key]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    last = placed.groupBy(key).agg(F.max_by(F.struct(*names, "_at"), "_at").alias("_last"))
    return last.select(key, *(F.col("_last")[c].alias(c) for c in [*names, "_at"]))


# Nodes


def upsert_nodes(graph: Graph, rows: DataFrame, now: int, expected_revision: int | None = None, checks: list[Callable[[DataFrame], None]] = ()) -> Graph:
    """Inserts or replaces ``rows`` (id, type, data and any node columns); replacing adds 1 to the revision.

    All ``checks`` run on the whole batch first.  Of rows that repeat an id
    the last stays, and new nodes are numbered in the order of their rows.  With ``expected_revision`` every row must meet a node of it.
    """
    _none(rows.where("id is null or id = '' or type is null or type = ''"), S.GraphError)
    for check in checks:
        check(rows)
    full = last_of_each(Graph.of(rows, graph.edges).nodes)
    old = graph.nodes.select("id", F.col("revision").alias("_old"), F.col("_seq").alias("_old_seq"), F.col("inserted_at").alias("_old_time"))
    met = full.join(old, "id", "left")
    if expected_revision is not None:
        _none(met.where(~F.col("_old").eqNullSafe(F.lit(expected_revision))).select("id", "_old"), S.Conflict)
    last = graph.nodes.agg(F.coalesce(F.max("_seq"), F.lit(0)).alias("m")).first()["m"]
    new = met.withColumns({
        "revision": F.coalesce(F.col("_old") + 1, F.lit(0)).cast("long"),
        "_seq": F.coalesce("_old_seq", F.lit(last + 1) + F.col("_at")),
        "inserted_at": F.coalesce("inserted_at", "_old_time", F.lit(now)).cast("long"),
        "updated_at": F.coalesce("updated_at", F.lit(now)).cast("long"),
    })
    kept = graph.nodes.join(full.select("id"), "id", "left_anti")
    return replace(graph, nodes=kept.unionByName(new.select(graph.nodes.columns)))


def _at(path: str) -> str:
    return path.removeprefix("data.")


_TOP = ("type", "memory_class", "confidence", "source", "observed_at", "derived_from", "supersedes", "contradicts", "vector")


def patch_nodes(graph: Graph, ids: DataFrame, now: int, compare_and_set: dict[str, tuple[Any, Any]] | None = None, set_: dict[str, Any] | None = None, unset: list[str] = (), increment: dict[str, float] | None = None, expected_revision: int | None = None) -> Graph:
    """Patches the nodes of ``ids(id)`` whose ``data`` is a STRUCT: compare-and-set, then set, unset, increment.

    Paths of dots begin at ``data`` or name a provenance column.  Unset makes
    a field null.  A missing node, another revision, a comparison that fails
    or a field that isn't a number to increment raises, and nothing changes.
    """
    ids = ids.select("id").distinct()
    _none(ids.join(graph.nodes.select("id"), "id", "left_anti"), S.NotFound)
    own = graph.nodes.join(ids, "id", "left_semi")
    value = lambda p: F.col(p) if p in _TOP else F.col("data." + _at(p))
    if expected_revision is not None:
        _none(own.where(F.col("revision") != expected_revision).select("id", "revision"), S.Conflict)
    for path, (expected, _) in (compare_and_set or {}).items():
        _none(own.where(~value(path).eqNullSafe(F.lit(expected))).select("id", value(path).alias("found")), S.Conflict)
    for path in increment or {}:
        _none(own.where(value(path).cast("double").isNull() & value(path).isNotNull()).select("id"), S.GraphError)
    sets = {**{p: v for p, (_, v) in (compare_and_set or {}).items()}, **(set_ or {}), **dict.fromkeys(unset)}
    out = own
    for path, v in sets.items():
        kind = own.select(value(path).alias("x")).schema["x"].dataType
        new = F.lit(v).cast(kind) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast(kind)
        out = out.withColumn(path, new) if path in _TOP else out.withColumn("data", F.col("data").withField(_at(path), new))
    for path, by in (increment or {}).items():
        kind = own.select(value(path).alias("x")).schema["x"].dataType
        new = (F.coalesce(value(path), F.lit(0)) + F.lit(by)).cast(kind)
        out = out.withColumn(path, new) if path in _TOP else out.withColumn("data", F.col("data").withField(_at(path), new))
    out = out.withColumn("revision", F.col("revision") + 1).withColumn("updated_at", F.lit(now).cast("long"))
    return replace(graph, nodes=graph.nodes.join(ids, "id", "left_anti").unionByName(out.select(graph.nodes.columns)))


def update_nodes(graph: Graph, changes: DataFrame, now: int) -> Graph:
    """Merges ``changes(id, field ...)`` into ``data``: the fields given replace, others stay; ids without a node are passed over.

    Of changes that repeat an id the last counts.
    """
    names = [c for c in changes.columns if c != "id"]
    new = last_of_each(changes).select("id", F.struct(*names).alias("_new"))
    met = graph.nodes.join(new, "id", "left")
    data = F.col("data")
    for n in names:
        data = data.withField(n, F.col("_new")[n])
    on = F.col("_new").isNotNull()
    out = met.withColumns({"data": F.when(on, data).otherwise(F.col("data")), "revision": F.col("revision") + F.when(on, 1).otherwise(0), "updated_at": F.when(on, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})
    return replace(graph, nodes=out.select(graph.nodes.columns))


def set_vectors(graph: Graph, vectors: DataFrame) -> Graph:
    """Replaces the vectors of ``vectors(id, vector)``, by the last of an id; a null one removes it."""
    met = graph.nodes.join(last_of_each(vectors.select("id", "vector")).select("id", F.col("vector").cast("array<double>").alias("_v"), F.lit(True).alias("_on")), "id", "left")
    return replace(graph, nodes=met.withColumn("vector", F.when(F.col("_on"), F.col("_v")).otherwise(F.col("vector"))).select(graph.nodes.columns))


def upsert_embedded(graph: Graph, rows: DataFrame, text: Column, now: int, provider: Callable[[Column], Column] = feature_hash, dimensions: int | None = None, **options: Any) -> Graph:
    """``upsert_nodes`` of ``rows`` with the vectors that ``provider``, a function of columns, gives their ``text``.

    A null text gives no vector.  A vector that is empty, has a number that
    isn't finite, or another size than ``dimensions`` raises, and nothing changes.
    """
    new = rows.withColumn("vector", provider(text).cast("array<double>"))
    size = F.size("vector")
    _none(new.where(F.col("vector").isNotNull() & ((size == 0) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))).select("id"), S.GraphError)
    if dimensions is not None:
        _none(new.where(F.col("vector").isNotNull() & (size != dimensions)).select("id", size.alias("size")), S.DimensionMismatch)
    return upsert_nodes(graph, new, now, **options)


# Edges


def add_edges(graph: Graph, rows: DataFrame, now: int, checks: list[Callable[[DataFrame], None]] = ()) -> Graph:
    """Adds ``rows(source, type, target, ...)``; an id that exists changes nothing, of new rows that repeat one the last stays.

    Parallel edges need ids of their own.
    """
    for check in checks:
        check(rows)
    full = last_of_each(Graph.of(graph.nodes, rows).edges).join(graph.edges.select("id"), "id", "left_anti")
    _none(full.where(~F.col("ownership").isin(*S.OWNERSHIP)).select("id", "ownership"), S.GraphError)
    last = graph.edges.agg(F.coalesce(F.max("_seq"), F.lit(0)).alias("m")).first()["m"]
    new = full.withColumns({"_seq": F.lit(last + 1) + F.col("_at"), "created_at": F.coalesce("created_at", F.lit(now)).cast("long")})
    return replace(graph, edges=graph.edges.unionByName(new, allowMissingColumns=True).select(graph.edges.columns))


def update_edges(graph: Graph, changes: DataFrame) -> Graph:
    """Merges ``changes(id, field ...)`` into the edges' ``data``."""
    edges = update_nodes(Graph(graph.edges.withColumn("updated_at", F.lit(0).cast("long")), graph.edges), changes, 0).nodes
    return replace(graph, edges=edges.select(graph.edges.columns))


def cascade(graph: Graph, ids: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``ids(id)`` and all that is owned only by what goes, to a fixpoint whatever the order of edges."""
    owned = graph.edges.where("ownership = 'owned'").select("source", F.col("target").alias("id")).distinct()
    gone = _cut(ids.select("id").distinct())
    for _ in range(max_rounds):
        owners = owned.join(gone.select(F.col("id").alias("source"), F.lit(1).alias("_gone")), "source", "left")
        new = owners.groupBy("id").agg(F.count("*").alias("n"), F.count("_gone").alias("g")).where("n = g").select("id").join(gone, "id", "left_anti")
        new = _cut(new)
        if new.isEmpty():
            return gone
        gone = _cut(gone.unionByName(new))
    raise S.ResourceLimit("cascade")


def remove_nodes(graph: Graph, ids: DataFrame, expected_revision: int | None = None) -> tuple[Graph, DataFrame]:
    """Without the nodes, what they alone own, and the edges at these; and the removed ids.  Ids without a node are passed over."""
    own = graph.nodes.join(ids.select("id"), "id", "left_semi")
    if expected_revision is not None:
        _none(own.where(F.col("revision") != expected_revision).select("id", "revision"), S.Conflict)
    gone = cascade(graph, own.select("id"))
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(graph.edges.columns)), gone


def remove_edges(graph: Graph, which: Column) -> tuple[Graph, DataFrame, DataFrame]:
    """Without the edges for which ``which`` holds: ``(graph, removed node ids, orphans)``.

    Targets of removed owned edges that no owned edge reaches any more go with
    their cascade; targets of removed shared edges that no edge at all reaches
    are reported as orphans and stay.
    """
    out = graph.edges.where(which)
    rest = graph.edges.where(~F.coalesce(which, F.lit(False)))
    left = replace(graph, edges=rest)
    ids = lambda kind: out.where(F.col("ownership") == kind).select(F.col("target").alias("id")).distinct()
    alone = ids("owned").join(rest.where("ownership = 'owned'").select(F.col("target").alias("id")), "id", "left_anti")
    orphans = ids("shared").join(rest.select(F.col("target").alias("id")), "id", "left_anti").join(graph.nodes.select("id"), "id", "left_semi")
    after, gone = remove_nodes(left, alone)
    return after, gone, orphans.join(gone, "id", "left_anti")


def delete_by_type(graph: Graph, type_: str) -> tuple[Graph, DataFrame]:
    return remove_nodes(graph, graph.of_type(type_).select("id"))


def prune(graph: Graph, max_nodes: int) -> tuple[Graph, DataFrame]:
    """Removes the oldest by inserted_at, with their cascade, until ``max_nodes`` or fewer are left."""
    excess = graph.nodes.count() - max_nodes
    return remove_nodes(graph, graph.nodes.orderBy("inserted_at", "_seq").limit(max(0, excess)).select("id"))


def supersede(graph: Graph, new: str, old: str, now: int, amount: float = 1.0) -> Graph:
    """``new`` supersedes ``old``: its column says so, an edge leads from old to new, and old is suppressed."""
    spark = graph.nodes.sparkSession
    pair = spark.createDataFrame([(new,), (old,)], "id string")
    _none(pair.join(graph.nodes.select("id"), "id", "left_anti"), S.NotFound)
    out = replace(graph, nodes=graph.nodes.withColumn("supersedes", F.when(F.col("id") == new, F.lit(old)).otherwise(F.col("supersedes"))))
    out = add_edges(out, spark.createDataFrame([(old, "SUPERSEDED_BY", new)], "source string, type string, target string"), now)
    return activation.suppress(out, spark.createDataFrame([(old, float(amount))], "id string, delta double"), now)


def consolidate(graph: Graph, node: DataFrame, source_ids: list[str], now: int, edge_type: str = "CONSOLIDATES", amount: float = 1.0) -> Graph:
    """Upserts the one row of ``node`` with the sources merged into derived_from, links and suppresses them; nothing where a source is missing."""
    if not source_ids:
        raise S.GraphError("no sources")
    spark = graph.nodes.sparkSession
    wanted = list(dict.fromkeys(source_ids))
    sources = spark.createDataFrame([(s,) for s in wanted], "id string")
    if not sources.join(graph.nodes.select("id"), "id", "left_anti").isEmpty():
        return graph
    had = F.coalesce(F.col("derived_from"), F.array().cast("array<string>")) if "derived_from" in node.columns else F.array().cast("array<string>")
    out = upsert_nodes(graph, node.withColumn("derived_from", F.array_distinct(F.concat(had, F.array(*map(F.lit, wanted))))), now)
    key = node.first()["id"]
    out = add_edges(out, sources.select(F.lit(key).alias("source"), F.lit(edge_type).alias("type"), F.col("id").alias("target")), now)
    return activation.suppress(out, sources.withColumn("delta", F.lit(float(amount))), now)


# Constraints


@dataclass(frozen=True)
class NodeSchema:
    """What nodes of a type need; field types are those of Spark's DDL or string, number, integer, boolean, object, array."""

    type: str
    required: tuple[str, ...] = ()
    data_types: dict[str, str] = field(default_factory=dict)
    validate: Column | None = None

    _KINDS = {"string": ("string",), "number": ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal"), "integer": ("bigint", "int", "smallint", "tinyint"), "boolean": ("boolean",), "object": ("struct", "map"), "array": ("array",)}

    def violations(self, rows: DataFrame) -> DataFrame:
        from lodegraph.functions.fields import Fields

        own, fields = rows.where(F.col("type") == self.type), Fields(rows)
        bad = [(f"{f} is missing", ~fields.present(f)) for f in self.required]
        for name, wanted in self.data_types.items():
            kind = fields.type_of(name)
            ok = kind is None or kind.simpleString().split("<")[0].split("(")[0] in self._KINDS[wanted]
            if not ok:
                bad.append((f"{name} is no {wanted}", fields.present(name)))
        if self.validate is not None:
            bad.append(("validate", ~F.coalesce(self.validate, F.lit(False))))
        out = own.select("id", F.array_compact(F.array(*[F.when(c, m) for m, c in bad]) if bad else F.array().cast("array<string>")).alias("problems"))
        return out.where(F.size("problems") > 0)

    def __call__(self, rows: DataFrame) -> None:
        _none(self.violations(rows), S.GraphError)


@dataclass(frozen=True)
class EdgeSchema:
    type: str
    source_types: tuple[str, ...] | None = None
    target_types: tuple[str, ...] | None = None
    cardinality: str | None = None  #: one-to-one, one-to-many, many-to-one

    def violations(self, graph: Graph) -> DataFrame:
        """``(id, problem)``; of a cardinality, id is the end that has too many."""
        own = graph.edges.where(F.col("type") == self.type)
        types = graph.nodes.select(F.col("id").alias("_n"), F.col("type").alias("_t"))
        out = own.limit(0).select("id", F.lit("").alias("problem"))
        for end, allowed in (("source", self.source_types), ("target", self.target_types)):
            if allowed is not None:
                met = own.join(types, F.col(end) == F.col("_n"), "left")
                out = out.unionByName(met.where(~F.coalesce(F.col("_t").isin(*allowed), F.lit(False))).select("id", F.lit(f"{end} type").alias("problem")))
        limited = {"one-to-one": ("source", "target"), "one-to-many": ("target",), "many-to-one": ("source",), None: ()}[self.cardinality]
        for end in limited:
            out = out.unionByName(own.groupBy(end).count().where("count > 1").select(F.col(end).alias("id"), F.lit(f"{self.cardinality}: {end}").alias("problem")))
        return out

    def __call__(self, graph: Graph) -> None:
        _none(self.violations(graph), S.GraphError)


@dataclass(frozen=True)
class Index:
    """A secondary index is a declaration: Parquet statistics serve lookups; ``unique`` is a constraint.

    A sparse one passes over nodes that miss one of its fields.
    """

    name: str
    fields: tuple[str, ...]
    unique: bool = False
    sparse: bool = False
    type: str | None = None

    def violations(self, nodes: DataFrame) -> DataFrame:
        from lodegraph.functions.fields import Fields

        f = Fields(nodes)
        own = nodes if self.type is None else nodes.where(F.col("type") == self.type)
        for n in self.fields if self.sparse else ():
            own = own.where(f.present(n))
        keys = [f.key(n).alias(f"_{i}") for i, n in enumerate(self.fields)]
        repeated = own.select("id", *keys).groupBy(*[f"_{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
        return repeated.select("id", "n") if self.unique else repeated.limit(0).select("id", "n")

    def __call__(self, nodes: DataFrame) -> None:
        _none(self.violations(nodes), S.Conflict)


def within_limits(max_vector_dimensions: int | None = None, max_payload_bytes: int | None = None, max_batch: int | None = None) -> Callable[[DataFrame], None]:
    """A check of a batch of nodes against resource limits."""

    def check(rows: DataFrame) -> None:
        if max_batch is not None and rows.limit(max_batch + 1).count() > max_batch:
            raise S.ResourceLimit("max_batch")
        if max_vector_dimensions is not None and "vector" in rows.columns:
            _none(rows.where(F.size("vector") > max_vector_dimensions).select("id"), S.ResourceLimit)
        if max_payload_bytes is not None and "data" in rows.columns:
            _none(rows.where(F.octet_length(F.to_json("data")) > max_payload_bytes).select("id"), S.ResourceLimit)

    return check


def valid_provenance(rows: DataFrame) -> None:
    """Ranges and kinds of activation and provenance columns."""
    c = rows.columns
    bad = [~F.col("memory_class").isin(*S.MEMORY_CLASSES)] * ("memory_class" in c) + [~F.col("confidence").between(0, 1)] * ("confidence" in c) + [F.col("source") == ""] * ("source" in c)
    bad += [F.col("observed_at") < 0] * ("observed_at" in c) + [F.exists("derived_from", lambda x: x.isNull() | (x == ""))] * ("derived_from" in c)
    if "activation" in c:
        a = F.col("activation")
        bad += [~a[k].between(0, 1) for k in ("score", "importance")] + [a[k] < 0 for k in ("reinforcement_count", "last_meaningful_activation")]
    if bad:
        wrong = bad[0]
        for b in bad[1:]:
            wrong = F.coalesce(wrong, F.lit(False)) | F.coalesce(b, F.lit(False))
        _none(rows.where(wrong).select("id"), S.GraphError)


class Transaction:
    """Stages mutations on one graph; ``commit`` returns it after the checks, leaving the block on an error drops it.

    ``with Transaction(graph) as t: t.graph = upsert_nodes(t.graph, ...)``
    """

    def __init__(self, graph: Graph, checks: list[Callable[[Graph], None]] = ()) -> None:
        self.before = self.graph = graph
        self.checks, self.open = checks, False

    def __enter__(self) -> Transaction:
        if self.open:
            raise S.GraphError("transactions don't nest")
        self.open = True
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.open = False
        if kind is None:
            try:
                for check in self.checks:
                    check(self.graph)
            except Exception:
                self.graph = self.before
                raise
        else:
            self.graph = self.before
