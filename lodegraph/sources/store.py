"""A graph store: Parquet snapshots and deltas named by a manifest, and an append-only mutation log.

Everything is written by Spark to new folders; a commit is one manifest more.
Manifests are one-row Parquet tables too, so a store can be anywhere that
Spark can write.  Readers resolve the newest whole manifest; folders that none
names are leftovers of failed commits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from lodegraph import schema as S
from lodegraph.operators.graph import Graph

LOG = "sequence bigint, operation_id string, transaction_id string, actor string, timestamp bigint, base_revision bigint, operations array<struct<op:string,id:string,revision:bigint>>, metadata map<string,string>"

#: Changes in one record of the log, about.
LOG_ROWS = 10_000

#: What a store offers; ``require`` tests against it.
CAPABILITIES = {"persistence": True, "transactions": True, "mutation_log": True, "secondary_indexes": True, "vector_search": True, "approximate_search": True, "migrations": True, "change_feed": True}


def require(*names: str) -> None:
    if missing := [n for n in names if not CAPABILITIES.get(n)]:
        raise S.GraphError(f"not offered: {missing}")


@dataclass(frozen=True)
class Manifest:
    version: int
    sequence: int
    nodes: list[str]  #: the snapshot, then deltas of whole rows, newest last
    edges: list[str]
    removed: list[str]  #: deltas of removed ids, one for each delta ('' for none)
    log: list[str]
    applied: list[str]  #: transaction and operation ids, as tables


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Manifests

    def manifest(self) -> Manifest | None:
        try:
            row = self.spark.read.schema("version bigint, body string").parquet(f"{self.path}/manifest/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            return None
        return Manifest(**json.loads(row[0]["body"])) if row else None

    def _publish(self, m: Manifest) -> None:
        """Fails where the version exists.

        Spark tests for the folder before it writes, so this finds a writer
        that came earlier but is no lock: two that publish in the same moment
        need a lock of their own.
        """
        body = self.spark.createDataFrame([(m.version, json.dumps(m.__dict__))], "version bigint, body string").coalesce(1)
        try:
            body.write.mode("errorifexists").parquet(f"{self.path}/manifest/{m.version:012d}")
        except AnalysisException as e:
            raise S.Conflict(f"version {m.version} exists") from e

    def _put(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    # Whole graphs

    def save(self, graph: Graph) -> Manifest:
        """Writes the whole graph as a new snapshot, nodes partitioned by type; the log stays."""
        old = self.manifest()
        nodes = f"nodes-{uuid.uuid4().hex}"
        graph.nodes.write.partitionBy("type").parquet(f"{self.path}/{nodes}")
        new = Manifest((old.version if old else 0) + 1, old.sequence if old else 0, [nodes], [self._put(graph.edges, "edges")], [], old.log if old else [], old.applied if old else [])
        self._publish(new)
        return new

    def load(self, version: Manifest | None = None) -> Graph:
        m = version or self.manifest()
        if m is None:
            raise S.NotFound(self.path)
        return Graph(self._rows(m.nodes, m.removed, "node"), self._rows(m.edges, m.removed, "edge"))

    def _rows(self, names: list[str], removed: list[str], kind: str) -> DataFrame:
        """The snapshot with its deltas: the newest row of each id, unless a later delta removed it.

        The snapshot only loses the ids that deltas name, so its files are
        neither shuffled nor sorted and a predicate reaches them; only the
        deltas, far smaller, are grouped.
        """
        base = self.spark.read.parquet(f"{self.path}/{names[0]}")
        if len(names) == 1:
            return base
        put, gone = base.limit(0).withColumn("_v", F.lit(0)), self.spark.createDataFrame([], "id string, _gone int")
        for v, name in enumerate(names[1:], 1):
            put = put.unionByName(self.spark.read.parquet(f"{self.path}/{name}").withColumn("_v", F.lit(v)), allowMissingColumns=True)
        for v, name in enumerate(removed, 1):
            if name:
                gone = gone.unionByName(self.spark.read.parquet(f"{self.path}/{name}").where(F.col("kind") == kind).select("id", F.lit(v).alias("_gone")))
        gone = gone.groupBy("id").agg(F.max("_gone").alias("_gone"))
        newest = put.groupBy("id").agg(F.max_by(F.struct(*base.columns), "_v").alias("_row"), F.max("_v").alias("_v"))
        alive = newest.join(gone, "id", "left").where("_gone is null or _gone < _v").select("_row.*")
        touched = put.select("id").unionByName(gone.select("id")).distinct()
        return base.join(touched, "id", "left_anti").select(base.columns).unionByName(alive)

    def count(self, predicate: str | None = None, type_: str | None = None, offset: int = 0, limit: int | None = None) -> int:
        """Nodes of a type that meet a predicate, or how many of them a page holds; no row comes to the driver."""
        out = self.load().nodes
        out = out if type_ is None else out.where(F.col("type") == type_)
        return page_count((out if predicate is None else out.where(predicate)).count(), offset, limit)

    # Changes

    def commit(self, put_nodes: DataFrame | None = None, put_edges: DataFrame | None = None, delete_nodes: DataFrame | None = None, delete_edges: DataFrame | None = None, *, timestamp: int, operation_id: str | None = None, transaction_id: str | None = None, actor: str | None = None, base_sequence: int | None = None, metadata: dict[str, str] | None = None, log_operations: bool = True) -> Manifest:
        """Adds one delta and one log record; a known operation or transaction id changes nothing.

        ``base_sequence``: raises Conflict if the store has moved on.  The log
        record lists the changed ids.
        """
        m = self.manifest()
        if m is None:
            raise S.NotFound(self.path)
        identities = [("operation", operation_id), ("transaction", transaction_id)]
        identities = [(k, v) for k, v in identities if v is not None]
        if identities and m.applied:
            known = self.spark.read.parquet(*[f"{self.path}/{n}" for n in m.applied])
            if not known.where(F.col("identity").isin(*[f"{k}:{v}" for k, v in identities])).isEmpty():
                return m
        if base_sequence is not None and base_sequence != m.sequence:
            raise S.Conflict(f"sequence {m.sequence}, not {base_sequence}")
        graph_nodes, graph_edges = self.spark.read.parquet(f"{self.path}/{m.nodes[0]}").schema, self.spark.read.parquet(f"{self.path}/{m.edges[0]}").schema
        empty = lambda schema: self.spark.createDataFrame([], schema)
        nodes = self._put(put_nodes if put_nodes is not None else empty(graph_nodes), "nodes")
        edges = self._put(put_edges if put_edges is not None else empty(graph_edges), "edges")
        gone = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in (("node", delete_nodes), ("edge", delete_edges)) if df is not None]
        removed = self._put(gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1]), "removed") if gone else ""
        sequence = m.sequence + 1
        changes = [(op, df, rev) for op, df, rev in (("putNode", put_nodes, "revision"), ("putEdge", put_edges, "revision"), ("deleteNode", delete_nodes, None), ("deleteEdge", delete_edges, None)) if df is not None and log_operations]
        listed = empty(StructType.fromDDL("op string, id string, revision bigint"))
        for op, df, rev in changes:
            listed = listed.unionByName(df.select(F.lit(op).alias("op"), "id", (F.col(rev) if rev and rev in df.columns else F.lit(None)).cast("bigint").alias("revision")))
        # One record of at most about LOG_ROWS changes; a commit of more has several, of one sequence.
        whole = F.sort_array(F.collect_list(F.struct("op", "id", "revision"))).alias("operations")
        parts = -(-sum(df.count() for df in self._written([nodes, edges, removed] if log_operations else [])) // LOG_ROWS)
        chunks = listed.agg(whole) if parts <= 1 else listed.groupBy(F.pmod(F.xxhash64("op", "id"), F.lit(parts))).agg(whole)
        record = chunks.select(
            F.lit(sequence).cast("bigint").alias("sequence"), F.lit(operation_id or f"op-{sequence}").alias("operation_id"), F.lit(transaction_id or f"tx-{sequence}").alias("transaction_id"), F.lit(actor).cast("string").alias("actor"),
            F.lit(timestamp).cast("bigint").alias("timestamp"), F.lit(base_sequence).cast("bigint").alias("base_revision"), "operations",
            F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>").alias("metadata"),
        )
        applied = [*m.applied, self._put(self.spark.createDataFrame([(f"{k}:{v}",) for k, v in identities], "identity string"), "applied")] if identities else m.applied
        new = Manifest(m.version + 1, sequence, [*m.nodes, nodes], [*m.edges, edges], [*m.removed, removed], [*m.log, self._put(record, "log")], applied)
        self._publish(new)
        return new

    def _written(self, names: list[str]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{n}") for n in names if n]

    def compact(self, threshold: int = 1) -> Manifest:
        """Rewrites snapshot and deltas as one snapshot where there are ``threshold`` deltas or more."""
        m = self.manifest()
        return self.save(self.load(m)) if m and len(m.nodes) - 1 >= threshold else m

    def copy_to(self, path: str) -> Store:
        """A backup: the whole graph, log and identities at one version, as a store of its own.  Restoring is copying back."""
        m, other = self.manifest(), Store(self.spark, path)
        graph = self.load(m)
        log = [other._put(self.log(), "log")] if m.log else []
        applied = [other._put(self.spark.read.parquet(*[f"{self.path}/{n}" for n in m.applied]), "applied")] if m.applied else []
        nodes = other._put(graph.nodes, "nodes")
        other._publish(Manifest(1, m.sequence, [nodes], [other._put(graph.edges, "edges")], [], log, applied))
        return other

    # The mutation log

    def log(self) -> DataFrame:
        m = self.manifest()
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{n}" for n in m.log]) if m and m.log else self.spark.createDataFrame([], LOG)

    def log_since(self, sequence: int, limit: int | None = None) -> DataFrame:
        """Records after ``sequence``, in order; a page of ``limit`` commits, each with all its records."""
        out = self.log().where(F.col("sequence") > sequence)
        if limit is not None:
            out = out.join(out.select("sequence").distinct().orderBy("sequence").limit(limit), "sequence", "left_semi")
        return out.orderBy("sequence")

    def latest_sequence(self) -> int:
        m = self.manifest()
        return m.sequence if m else 0

    def retain(self, now: int, max_entries: int | None = None, max_age: int | None = None) -> Manifest:
        """Drops log records beyond the newest ``max_entries`` or older than ``max_age``; identities stay."""
        m = self.manifest()
        keep = self.log()
        if max_entries is not None:
            keep = keep.where(F.col("sequence") > m.sequence - max_entries)
        if max_age is not None:
            keep = keep.where(F.col("timestamp") >= now - max_age)
        new = Manifest(**{**m.__dict__, "version": m.version + 1, "log": [self._put(keep, "log")]})
        self._publish(new)
        return new

    def to_precision(self, kind: str) -> Manifest:
        """Rewrites all vectors as float32 values (``float``) or leaves them doubles (``double``)."""
        from lodegraph.operators.vector import as_float32

        graph = self.load()
        return self.save(Graph(as_float32(graph.nodes), graph.edges) if kind == "float" else graph)


def scan(spark: SparkSession, path: str, predicate: str | None = None, order: list[str] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """A persisted scan: predicate, order and page; the predicate reaches the snapshot's Parquet files, with deltas too."""
    out = Store(spark, path).load().nodes
    out = out if predicate is None else out.where(predicate)
    if order:
        out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def page_count(total: int, offset: int = 0, limit: int | None = None) -> int:
    """Rows of a page out of ``total``."""
    left = max(0, total - offset)
    return left if limit is None else min(left, limit)
