"""Change feeds and sync: streams over the mutation log and over operation batches, applied exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lodegraph import schema as S
from lodegraph.operators import activation
from lodegraph.operators.graph import Graph
from lodegraph.sources.store import LOG

#: An operation as clients send it; payload is JSON.
OPS = "client_id string, seq bigint, operation_id string, transaction_id string, timestamp bigint, kind string, payload string"
KINDS = ("addNode", "updateNode", "removeNode", "addEdge", "updateEdge", "removeEdges", "activationUpdate", "inhibitionUpdate")

# 32-bit FNV-1a.
_FNV_START, _FNV_PRIME = 2166136261, 16777619


def checksum(ops: list[dict]) -> str:
    """FNV-1a over the UTF-16 units of the compact JSON of an ordered batch, as 8 hex digits."""
    value = _FNV_START
    units = json.dumps(ops, separators=(",", ":"), ensure_ascii=False).encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        value = (value ^ (units[i] | units[i + 1] << 8)) * _FNV_PRIME & 0xFFFFFFFF
    return f"{value:08x}"


def identity_checksum(operation_ids: list[str], transaction_ids: list[str]) -> str:
    """The checksum of the identities kept for deduplication, in the form of one operation."""
    payload = {"operationIds": sorted(operation_ids), "transactionIds": sorted(transaction_ids)}
    return checksum([{"seq": 0, "timestamp": 0, "clientId": "sync-identities", "kind": "addNode", "payload": payload}])


def batch_checksum(ops: DataFrame) -> DataFrame:
    """``ops(batch, position, op)``, op as JSON text, -> ``(batch, checksum)``; a batch is what one message holds."""
    @F.pandas_udf("string")
    def digest(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: checksum(json.loads(body)))

    body = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "op"))), lambda x: x["op"]), ","), F.lit("]"))
    return ops.groupBy("batch").agg(body.alias("body")).select("batch", digest("body").alias("checksum"))


def valid(ops: DataFrame) -> Column:
    """Whether an operation has a known kind, a client, a sequence and a time."""
    return F.col("kind").isin(*KINDS) & F.col("client_id").isNotNull() & (F.col("client_id") != "") & (F.col("seq") >= 0) & (F.col("timestamp") >= 0)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The mutation log of a store as a stream, one row a committed record."""
    return spark.readStream.schema(LOG).parquet(f"{path}/log-*")


def changes(log: DataFrame) -> DataFrame:
    """``(sequence, timestamp, op, id, revision)``: one row a changed node or edge.  Works on tables and streams."""
    return log.select("sequence", "timestamp", F.explode("operations").alias("o")).select("sequence", "timestamp", "o.*")


def on_change(log: DataFrame, call: Callable[[DataFrame], None], checkpoint: str, every: str = "200 milliseconds", ops: list[str] | None = None) -> StreamingQuery:
    """Calls ``call`` with the changes of each micro-batch that has any: a live query re-runs there."""

    def run(batch: DataFrame, _: int) -> None:
        rows = changes(batch)
        rows = rows if ops is None else rows.where(F.col("op").isin(*ops))
        if not rows.isEmpty():
            call(rows)

    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _identities(ops: DataFrame) -> Column:
    seq = F.concat_ws(":", F.lit("s"), "client_id", F.col("seq").cast("string"))
    op = F.when(F.col("operation_id").isNotNull(), F.concat_ws(":", F.lit("o"), "client_id", "operation_id"))
    return F.array_compact(F.array(seq, op))


@dataclass
class SyncServer:
    """Orders, deduplicates and keeps operations in Parquet tables under ``path``.

    Each ``submit`` is one batch; it may run inside ``foreachBatch``.  An
    operation is known by client and sequence, by client and operation id, or,
    from an earlier batch, by client and transaction id.  ``accept`` is a
    column condition; one refused operation refuses its whole transaction.
    """

    spark: SparkSession
    path: str
    accept: Callable[[DataFrame], Column] | None = None
    max_ops: int | None = None
    max_batch: int = 1000

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], schema)

    def ops(self) -> DataFrame:
        return self._table("ops", f"cursor bigint, {OPS}")

    def identities(self) -> DataFrame:
        return self._table("identities", "identity string")

    def latest(self) -> int:
        return self.ops().agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("m")).first()["m"]

    def submit(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Appends what is new and accepted and returns it, with cursors.  A batch_id that was submitted before changes nothing."""
        name = f"{self.path}/ops/{batch_id:012d}"
        group = F.coalesce(F.concat_ws(":", "client_id", "transaction_id"), F.lit(""))
        ok = valid(batch) if self.accept is None else valid(batch) & self.accept(batch)
        tagged = batch.withColumns({"_ids": _identities(batch), "_tx": F.when(F.col("transaction_id").isNotNull(), F.concat_ws(":", F.lit("t"), group)), "_ok": F.coalesce(ok, F.lit(False))})
        refused = tagged.where("not _ok")
        tagged = tagged.where("_ok").join(refused.select("_tx").where("_tx is not null").distinct(), "_tx", "left_anti")
        known = self.identities()
        tagged = tagged.join(known.withColumnRenamed("identity", "_tx"), "_tx", "left_anti")
        old = tagged.select("client_id", "seq", F.explode("_ids").alias("identity")).join(known, "identity", "left_semi").select("client_id", "seq").distinct()
        fresh = tagged.join(old, ["client_id", "seq"], "left_anti").dropDuplicates(["client_id", "seq"])
        one = Window.partitionBy("client_id", F.coalesce("operation_id", F.concat_ws(":", F.lit("seq"), F.col("seq").cast("string")))).orderBy("seq")
        fresh = fresh.withColumn("_n", F.row_number().over(one)).where("_n = 1")
        numbered = self._numbered(fresh.select(*batch.columns), self.latest(), f"{self.path}/staged/{batch_id:012d}")
        numbered.select("cursor", *batch.columns).write.mode("ignore").parquet(name)
        done = self.spark.read.schema(f"cursor bigint, {OPS}").parquet(name)
        done_tx = F.when(F.col("transaction_id").isNotNull(), F.concat_ws(":", F.lit("t"), "client_id", "transaction_id"))
        ids = done.select(F.explode(F.concat(_identities(done), F.array_compact(F.array(done_tx)))).alias("identity")).distinct()
        ids.write.mode("ignore").parquet(f"{self.path}/identities/{batch_id:012d}")
        return done

    def _numbered(self, ops: DataFrame, start: int, path: str) -> DataFrame:
        """``ops`` with cursors after ``start`` in the order of time, client and sequence, whatever their number.

        They are dealt into ranges of that order, written once, and numbered
        within each range after the count of all ranges before it.
        """
        keys = ["timestamp", "client_id", "seq"]
        ops.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
        dealt = self.spark.read.schema(f"{OPS}, _range int").parquet(path)
        sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))  # one row a range
        before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
        rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
        return dealt.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn("cursor", (F.col("_before") + F.col("_rank") + start).cast("bigint"))

    def since(self, cursor: int, client_id: str | None = None) -> DataFrame:
        """A page of operations after ``cursor``, without the client's own; raises if the retained ring begins later."""
        last = self.latest()
        if self.max_ops is not None and cursor < last - self.max_ops:
            raise S.GraphError("cursor_expired")
        out = self.ops().where(F.col("cursor") > cursor)
        out = out if client_id is None else out.where(F.col("client_id") != client_id)
        return out.orderBy("cursor").limit(self.max_batch)

    def serve(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:  # noqa: ANN003
        """Submits a stream of operations batch by batch."""
        out = stream.writeStream.foreachBatch(lambda batch, n: self.submit(batch, n) and None).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()


def apply_activation(graph: Graph, ops: DataFrame, now: int) -> Graph:
    """Activation and inhibition deltas of ``ops``: those of one node add up."""
    body = F.from_json("payload", "id string, delta double")
    rows = ops.select("kind", body.alias("p")).select("kind", "p.id", "p.delta").where("id is not null and delta is not null")
    out = activation.reinforce(graph, rows.where("kind = 'activationUpdate'"), now)
    return activation.suppress(out, rows.where("kind = 'inhibitionUpdate'"), now)


def fold(ops: DataFrame) -> DataFrame:
    """``(id, kind, payload)`` of the last node operation on each id: what a batch leaves to write or to remove."""
    body = F.get_json_object("payload", "$.id")
    nodes = ops.where(F.col("kind").isin("addNode", "updateNode", "removeNode")).withColumn("id", body)
    return nodes.groupBy("id").agg(F.max_by(F.struct("kind", "payload"), "cursor").alias("l")).select("id", "l.*")


def activation_totals(stream: DataFrame) -> DataFrame:
    """Summed deltas of each node over a stream or a table of operations."""
    body = F.from_json("payload", "id string, delta double")
    return stream.where("kind = 'activationUpdate'").select(body.alias("p")).select("p.id", "p.delta").groupBy("id").agg(F.sum("delta").alias("delta"))
