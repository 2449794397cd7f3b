"""The test tables as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodegraph import schema as S
from lodegraph.operators.graph import Graph

#: The time at which queries over the test tables read activation.
NOW = 1_735_689_600_000

_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "embeddings": "vec_id", "events": "event_id"}
_NAMES = {"orders": "order", "embeddings": "item", "events": "event"}


def millis(c: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("long")


def _nodes(table: DataFrame, name: str) -> DataFrame:
    kind, key = _NAMES.get(name, name), F.col(_KEYS[name])
    extra = {c: F.lit(None).cast(t) for c, t in S.NODE_COLUMNS.items()}
    extra |= {"id": F.concat_ws(":", F.lit(kind), key), "type": F.lit(kind), "revision": F.lit(0).cast("long"), "_seq": key.cast("long")}
    data = [c for c in table.columns if c != "embedding"]
    if name == "embeddings":
        extra["vector"] = F.col("embedding").cast("array<double>")
    if name == "events":
        at = millis(F.col("ts"))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
        state = F.struct(
            score.alias("score"), (score / 2).alias("importance"), F.lit(1).cast("long").alias("reinforcement_count"), at.alias("last_meaningful_activation"),
            F.when(F.col("event_type") == "error", 0.25).alias("inhibition"), F.when(F.col("event_type") == "error", at).alias("last_inhibited_at"), F.lit(None).cast("map<string,struct<score:double,last_meaningful_activation:bigint>>").alias("context"),
        )
        extra |= {"inserted_at": at, "updated_at": at, "activation": state.cast(S.ACTIVATION), "memory_class": F.when(F.col("event_type") == "purchase", "semantic").when(F.col("event_type") == "click", "episodic")}
    return table.select(*(c.alias(n) for n, c in extra.items()), F.struct(*data).alias("data"))


def _edges(source: Column, type_: str, target: Column, id_: Column | None = None, seq: Column | None = None) -> list[Column]:
    values = {"source": source, "type": F.lit(type_), "target": target, "ownership": F.lit("reference"), "created_at": F.lit(None).cast("long"), "revision": F.lit(0).cast("long")}
    values["id"] = id_ if id_ is not None else F.concat_ws("::", source, F.lit(type_), target)
    values["_seq"] = seq if seq is not None else F.xxhash64(values["id"])
    return [values[c].cast(t).alias(c) for c, t in S.EDGE_COLUMNS.items()]


def graph(spark: SparkSession, sf_dir: str, *types: str) -> Graph:
    """Nodes of the tables named, and the edges between them.

    Lineitem has no key, so the id of its edges is a hash of the whole row.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in types}
    parts = [_nodes(t[n], n) for n in types if n in _KEYS]
    if len(parts) > 1:  # one struct with the fields of all
        fields = {f.name: f.dataType for p in parts for f in p.schema["data"].dataType.fields}
        same = lambda p: p.withColumn("data", F.struct(*(F.col("data")[n].alias(n) if n in p.schema["data"].dataType.names else F.lit(None).cast(k).alias(n) for n, k in fields.items())))
        parts = [same(p) for p in parts]
    name = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c))
    edges = []
    if {"customer", "orders"} <= set(types):
        edges.append(t["orders"].select(_edges(name("customer", "o_custkey"), "PLACED", name("order", "o_orderkey"), seq=F.col("o_orderkey"))))
    if {"customer", "nation"} <= set(types):
        edges.append(t["customer"].select(_edges(name("customer", "c_custkey"), "IN_NATION", name("nation", "c_nationkey"), seq=F.col("c_custkey"))))
    if {"supplier", "nation"} <= set(types):
        edges.append(t["supplier"].select(_edges(name("supplier", "s_suppkey"), "IN_NATION", name("nation", "s_nationkey"), seq=F.col("s_suppkey"))))
    if {"nation", "region"} <= set(types):
        edges.append(t["nation"].select(_edges(name("nation", "n_nationkey"), "IN_REGION", name("region", "n_regionkey"), seq=F.col("n_nationkey"))))
    if "lineitem" in types:
        row = F.sha2(F.concat_ws("|", *t["lineitem"].columns), 256)
        edges.append(t["lineitem"].select(_edges(name("order", "l_orderkey"), "CONTAINS", name("part", "l_partkey"), id_=row)))
        edges.append(t["lineitem"].select(_edges(name("order", "l_orderkey"), "SUPPLIED_BY", name("supplier", "l_suppkey"), id_=F.concat(F.lit("s"), row))))
    if "events" in types:
        edges.append(t["events"].select(_edges(name("user", "user_id"), "DID", name("event", "event_id"), seq=F.col("event_id"))))
        parts.append(t["events"].select("user_id").distinct().select(*(F.concat_ws(":", F.lit("user"), "user_id").alias(c) if c == "id" else F.lit("user").alias(c) if c == "type" else F.col("user_id").alias(c) if c == "_seq" else F.lit(None).cast(k).alias(c) for c, k in S.NODE_COLUMNS.items()), F.lit(None).cast(parts[0].schema["data"].dataType).alias("data")))
    if "conversations" in types:
        turn = lambda d: F.concat_ws(":", F.lit("turn"), "conv_id", (F.col("turn") + d).cast("string"))
        own = t["conversations"]
        parts.append(own.select(*(turn(0).alias(c) if c == "id" else F.lit("turn").alias(c) if c == "type" else (F.col("conv_id") * 1000 + F.col("turn")).alias(c) if c == "_seq" else F.lit(None).cast(k).alias(c) for c, k in S.NODE_COLUMNS.items()), F.struct("conv_id", "turn", "role").alias("data")))
        edges.append(own.where("turn > 0").select(_edges(turn(-1), "NEXT_TURN", turn(0), seq=F.col("conv_id") * 1000 + F.col("turn"))))
    nodes = reduce(DataFrame.unionByName, parts)
    links = reduce(DataFrame.unionByName, edges) if edges else spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in S.EDGE_COLUMNS.items()))
    return Graph(nodes, links)
