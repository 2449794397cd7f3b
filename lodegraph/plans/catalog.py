"""The graph operators over the test tables: ``QUERIES``, and their DuckDB equivalents in ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodegraph import schema as S
from lodegraph.functions import embedding, scalar
from lodegraph.operators import activation, mutate, traverse, vector
from lodegraph.operators.activation import Activation
from lodegraph.operators.graph import Graph
from lodegraph.plans.testgraph import NOW, graph
from lodegraph.sources import migrate
from lodegraph.sources.store import Store, scan
from lodegraph.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, digits)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with an order, richest first."""
    q = graph(spark, sf_dir, "customer", "orders").query().where_node_type("customer").where("c_mktsegment", "BUILDING").join("PLACED").order_by("c_acctbal", "desc").limit(20)
    return q.to_df().select("id", "type", F.col("data.c_acctbal").alias("c_acctbal"))


@query("""SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def filter_join_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("SELECT 'part:' || p_partkey AS id, p_name, p_retailprice FROM part WHERE p_retailprice > 920 AND p_retailprice < 950")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "part").query().where_node_type("part").where_attribute_range("p_retailprice", above=920, below=950)
    return q.pluck("p_name", "p_retailprice").drop("type")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 5")
def filter_edge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "supplier", "nation").query().where_edge("IN_NATION", "nation:5").ids()


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_custkey = 7")
def filter_edge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "orders").query().where_edge_source("customer:7").ids()


@query("SELECT 'nation:' || n_nationkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def filter_edge_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached from the customer by an IN_NATION edge, with an IN_REGION edge of its own found by the join."""
    return graph(spark, sf_dir, "customer", "nation", "region").query().where_edge_source("customer:1").join("IN_REGION").ids()


@query("SELECT 'turn:5:' || turn AS id FROM conversations WHERE conv_id = 5 AND turn = 1 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 5 AND turn = 2)")
def filter_edge_source_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Has a NEXT_TURN edge to turn 2 and is the target of one from turn 0: both edge filters apply."""
    return graph(spark, sf_dir, "conversations").query().where_edge("NEXT_TURN", "turn:5:2").where_edge_source("turn:5:0").ids()


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "orders").query().where_node_type("customer").join("PLACED", predicate=F.col("data.o_totalprice") > 400000).ids()


@query("SELECT 'order:' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey")
def join_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "orders").query().where_node_type("order").join("PLACED", "in").ids()


@query("SELECT DISTINCT 'nation:' || n_nationkey AS id, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey <> 0")
def collect_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "customer", "nation").query().where_node_type("customer").where("c_mktsegment", "BUILDING")
    return q.collect_neighbours("IN_NATION", predicate=F.col("data.n_regionkey") != 0).select("id", F.col("data.n_name").alias("n_name"))


@query("SELECT 'part:' || p_partkey AS id, 'part' AS type, p_brand, p_size FROM part")
def pluck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "part").query().pluck("p_brand", "data.p_size")


@query("""SELECT op, round(v, 4) AS value, n AS count FROM (SELECT sum(o_totalprice) s, avg(o_totalprice) a, min(o_totalprice) lo, max(o_totalprice) hi, count(o_totalprice) n FROM orders WHERE o_orderstatus = 'F') t,
LATERAL (VALUES ('sum', s), ('avg', a), ('min', lo), ('max', hi), ('count', CAST(n AS DOUBLE))) v(op, v)""")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "orders").query().where("o_orderstatus", "F")
    parts = [q.aggregate("o_totalprice", op).select(F.lit(op).alias("op"), _r("value", 4).alias("value"), "count") for op in ("sum", "avg", "min", "max", "count")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT CAST(0 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS count")
def aggregate_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "orders").query().aggregate("o_orderpriority", "sum")


@query("SELECT o_orderpriority AS key, round(avg(o_totalprice), 4) AS value, count(*) AS count FROM orders GROUP BY 1")
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "orders").query().group_aggregate("o_totalprice", "avg", "o_orderpriority").withColumn("value", _r("value", 4))


@query("SELECT CAST(p_size AS VARCHAR) AS key, CAST(count(p_name) AS DOUBLE) AS value, count(p_name) AS count FROM part GROUP BY p_size HAVING count(p_name) > 5")
def group_count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "part").query()
    return q.having(q.group_aggregate("p_name", "count", "p_size"), F.col("value") > 5)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer").query().where("c_custkey", 1).unique_keys("c_mktsegment")


@query("SELECT type, count(*) AS count FROM (SELECT 'customer' AS type FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'part' FROM part) GROUP BY type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "supplier", "part").nodes.groupBy("type").count()


@query("SELECT 'part:' || p_partkey AS id, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 10")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "part").query().order_by("p_retailprice", "desc").offset(10).limit(25)
    return q.to_df().select("id", F.col("data.p_retailprice").alias("p_retailprice"))


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, 0 AS hop FROM conversations WHERE turn = 0 UNION ALL
SELECT c.conv_id, c.turn, w.hop + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE w.hop < 2)
SELECT 'turn:' || conv_id || ':' || turn AS id, hop FROM w""")
def traverse_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "conversations")
    return traverse.reach(g.nodes.where("data.turn = 0"), g.edges, ["NEXT_TURN"], 2)


@query("""SELECT 'region:' || r_regionkey AS id FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def traverse_chain_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "customer", "nation", "region").query().where("r_regionkey", 1)
    return q.traverse("IN_REGION", 1, "in").traverse("IN_NATION", 1, "in").ids()


@query("""SELECT 'order:' || o_orderkey AS id, 1 AS hop FROM orders WHERE o_custkey = 4 UNION ALL
SELECT DISTINCT 'part:' || l_partkey, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 4 UNION ALL
SELECT DISTINCT 'supplier:' || l_suppkey, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 4""")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer", "orders", "part", "supplier", "lineitem")
    return Activation().spread(g, g.nodes.where("id = 'customer:4'"), depth=2).select("id", "hop")


@query("SELECT 'turn:' || conv_id || ':' || turn AS id, CAST(turn AS INTEGER) AS position FROM conversations WHERE conv_id = 3")
def walk_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = traverse.walk("turn:3:0", graph(spark, sf_dir, "conversations").edges, "NEXT_TURN", False)
    return spark.createDataFrame([(x, i) for i, x in enumerate(path)], "id string, position int")


@query("SELECT 'turn:' || conv_id || ':' || turn AS id, CAST(turn AS INTEGER) AS position FROM conversations WHERE conv_id = 3 AND turn <= 1")
def walk_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = traverse.walk("turn:3:1", graph(spark, sf_dir, "conversations").edges, "NEXT_TURN", True)
    return spark.createDataFrame([(x, i) for i, x in enumerate(path)], "id string, position int")


@query("SELECT id, position FROM (VALUES ('region', 0), ('nation', 1)) v(kind, position), (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 3), LATERAL (SELECT CASE kind WHEN 'region' THEN 'region:' || n_regionkey ELSE 'nation:3' END AS id)")
def walk_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = traverse.walk("nation:3", graph(spark, sf_dir, "nation", "region").edges, "IN_REGION", False)[::-1]
    return spark.createDataFrame([(x, i) for i, x in enumerate(path)], "id string, position int")


_FIRST_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT 'item:' || vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, {_FIRST_VECTOR} ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(graph(spark, sf_dir, "embeddings").nodes, _probe(spark, sf_dir), 10, -1.0).withColumn("score", _r("score"))


@query(f"SELECT 'item:' || vec_id AS id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), q)), 6) AS score FROM embeddings, {_FIRST_VECTOR} ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 10")
def vector_top_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(graph(spark, sf_dir, "embeddings").nodes, _probe(spark, sf_dir), 10, similarity="euclidean").withColumn("score", _r("score"))


@query(f"SELECT 'item:' || vec_id AS id, label FROM embeddings, {_FIRST_VECTOR} WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) >= 0.2")
def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "embeddings").query().similar_to(_probe(spark, sf_dir), 0.2).to_df().select("id", F.col("data.label").alias("label"))


@query()
def vector_top_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.approximate_top_k(graph(spark, sf_dir, "embeddings").nodes, _probe(spark, sf_dir), 10, -1.0).withColumn("score", _r("score"))


_CENTROIDS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id IN (0, 1, 2))"


@query(f"""WITH s AS (SELECT e.vec_id, label, k.vec_id AS k, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings e, {_CENTROIDS} k),
b AS (SELECT vec_id, any_value(label) AS label, max(s) AS s, arg_max(k, struct_pack(s := s, k := -k)) AS k FROM s GROUP BY vec_id)
SELECT CASE WHEN s > 0.1 THEN 'c' || k ELSE 'null' END AS key, CAST(sum(label) AS DOUBLE) AS value, count(*) AS count FROM b GROUP BY 1""")
def group_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id in (0, 1, 2)").orderBy("vec_id").collect()
    return graph(spark, sf_dir, "embeddings").query().group_by_vector({f"c{r['vec_id']}": [float(x) for x in r["embedding"]] for r in rows}, "label", "sum", 0.1)


# Activation, over events: score value / 100, anchored at the event.

_EVENTS = f"""e AS (SELECT event_id, event_type, value, props, least(1.0, greatest(0.0, value / 100)) AS s, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS t,
CASE event_type WHEN 'purchase' THEN {7 * S.DAY} WHEN 'click' THEN {12 * S.HOUR} ELSE {S.DAY} END AS h,
CASE event_type WHEN 'purchase' THEN {90 * S.DAY} WHEN 'click' THEN {7 * S.DAY} ELSE {30 * S.DAY} END AS hi FROM events)"""
_DECAYED = "s * pow(0.5::DOUBLE, greatest(0, {now} - t) / h::DOUBLE)"


@query("SELECT max(CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)) AS now FROM events")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "events").nodes.agg(F.max("inserted_at").alias("now"))


_CLOCK = "(SELECT max(CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)) FROM events)"


def _clock(spark: SparkSession, sf_dir: str) -> int:
    return event_clock(spark, sf_dir).first()["now"]


@query(f"WITH {_EVENTS} SELECT 'event:' || event_id AS id, round({_DECAYED.format(now=_CLOCK)}, 6) AS score FROM e")
def activation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "events").nodes.where("type = 'event'")
    half = scalar.class_half_life(F.col("memory_class"), 0, S.SCORE_HALF_LIFE)
    return n.select("id", _r(scalar.activation_score(F.col("activation"), _clock(spark, sf_dir), half)).alias("score"))


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(greatest(0, least(1, {_DECAYED.format(now=_CLOCK)} - CASE WHEN event_type = 'error' THEN 0.25 * pow(0.5::DOUBLE, ({_CLOCK} - t) / {12.0 * S.HOUR}) ELSE 0 END)), 6) AS effective FROM e""")
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Activation().effective(graph(spark, sf_dir, "events").nodes.where("type = 'event'"), _clock(spark, sf_dir)).select("id", _r("effective").alias("effective"))


@query(f"WITH {_EVENTS} SELECT 'event:' || event_id AS id, round({_DECAYED.format(now=_CLOCK)}, 6) AS score FROM e WHERE {_DECAYED.format(now=_CLOCK)} > 0.01 ORDER BY {_DECAYED.format(now=_CLOCK)} DESC, event_id LIMIT 15")
def top_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.top_activated(graph(spark, sf_dir, "events").nodes, _clock(spark, sf_dir), 15, 0.01).withColumn("score", _r("score"))


@query(f"WITH {_EVENTS} SELECT 'event:' || event_id AS id FROM e WHERE {_DECAYED.format(now=_CLOCK)} >= 0.3 ORDER BY {_DECAYED.format(now=_CLOCK)} DESC, event_id LIMIT 50")
def activated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "events").query().where_activated(0.3, _clock(spark, sf_dir)).order_by_activation().limit(50).ids()


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(least(1, {_DECAYED.format(now=_CLOCK)} + 0.1), 6) AS score, round(least(1, s / 2 * pow(0.5::DOUBLE, ({_CLOCK} - t) / hi::DOUBLE) + 0.005), 6) AS importance, CAST(2 AS BIGINT) AS n
FROM e WHERE event_type = 'view'""")
def reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "events")
    views = g.nodes.where("data.event_type = 'view'").select("id", F.lit(0.1).alias("delta"))
    out = activation.reinforce(g, views, _clock(spark, sf_dir)).nodes.where("data.event_type = 'view'")
    return out.select("id", _r("activation.score").alias("score"), _r("activation.importance").alias("importance"), F.col("activation.reinforcement_count").alias("n"))


@query(f"WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(least(1, 0.25 * pow(0.5::DOUBLE, ({_CLOCK} - t) / {12.0 * S.HOUR}) + 0.5), 6) AS inhibition FROM e WHERE event_type = 'error'")
def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "events")
    errors = g.nodes.where("data.event_type = 'error'").select("id", F.lit(0.5).alias("delta"))
    return activation.suppress(g, errors, _clock(spark, sf_dir)).nodes.where("data.event_type = 'error'").select("id", _r("activation.inhibition").alias("inhibition"))


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(greatest(s * pow(0.5::DOUBLE, ({_CLOCK} - t) / {float(S.SCORE_HALF_LIFE)}), 0.2), 6) AS score, CAST({_CLOCK} AS BIGINT) AS anchor FROM e""")
def merge_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, now = graph(spark, sf_dir, "events"), _clock(spark, sf_dir)
    own = g.nodes.where("type = 'event'")
    state = F.struct(F.lit(0.2).alias("score"), F.lit(0.0).alias("importance"), F.lit(1).cast("long").alias("reinforcement_count"), F.lit(now).cast("long").alias("last_meaningful_activation"), F.lit(None).cast("double").alias("inhibition"), F.lit(None).cast("long").alias("last_inhibited_at"), F.lit(None).cast("map<string,struct<score:double,last_meaningful_activation:bigint>>").alias("context"))
    out = activation.merge_activation(Graph(own, g.edges), own.select("id", state.alias("activation")), now).nodes
    return out.select("id", _r("activation.score").alias("score"), F.col("activation.last_meaningful_activation").alias("anchor"))


@query(f"WITH {_EVENTS} SELECT 'event:' || event_id AS id, round({_DECAYED.format(now=_CLOCK)}, 6) AS score, CAST({_CLOCK} AS BIGINT) AS anchor FROM e")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = activation.decay(graph(spark, sf_dir, "events"), _clock(spark, sf_dir)).nodes.where("type = 'event'")
    return out.select("id", _r("activation.score").alias("score"), F.col("activation.last_meaningful_activation").alias("anchor"))


@query(f"""WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, {_FIRST_VECTOR}), t AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 10)
SELECT 'item:' || vec_id AS id, round(s, 6) AS semantic, round(s + 1, 6) AS total FROM t WHERE s > 0""")
def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items have no edges and no time, so recency is 1 and what a pulse finds is its seeds."""
    found = Activation().pulse(graph(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), NOW)
    return found.select("id", _r("semantic").alias("semantic"), _r("total").alias("total"))


@query(f"""WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, {_FIRST_VECTOR}), t AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 10)
SELECT 'item:' || vec_id AS id, round(least(1, (s + 1) * 0.05), 6) AS score FROM t WHERE s > 0""")
def absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Activation().absorb(graph(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), NOW)
    return out.nodes.where("activation is not null").select("id", _r("activation.score").alias("score"))


@query(f"WITH {_EVENTS}, f AS (SELECT event_id, {_DECAYED.format(now=_CLOCK)} - CASE WHEN event_type = 'error' THEN 0.25 * pow(0.5::DOUBLE, ({_CLOCK} - t) / {12.0 * S.HOUR}) ELSE 0 END AS f FROM e) SELECT 'event:' || event_id AS id FROM f WHERE f > 0 ORDER BY f DESC, event_id LIMIT 10")
def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Activation().working_memory(graph(spark, sf_dir, "events").nodes, _clock(spark, sf_dir))
    return spark.createDataFrame([(r["id"],) for r in rows], "id string")


@query(ORACLE_SQL["working_memory"])
def working_memory_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, read from a store."""
    store = Store(spark, _folder(spark, "store"))
    store.save(graph(spark, sf_dir, "events"))
    rows = Activation().working_memory(store.load().nodes, _clock(spark, sf_dir))
    return spark.createDataFrame([(r["id"],) for r in rows], "id string")


@query()
def working_memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Activation().working_memory(graph(spark, sf_dir, "events").nodes, _clock(spark, sf_dir), limit=8, diversity=0.3, token_budget=300)
    return spark.createDataFrame([(r["id"],) for r in rows], "id string")


# Text

@query("SELECT 'part:' || p_partkey AS id, p_name || ' ' || p_name || ' ' || p_brand AS text FROM part")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "part").nodes
    return n.select("id", scalar.embedding_text({"name": F.col("data.p_name"), "brand": F.col("data.p_brand")}, {"name": 2}).alias("text"))


@query()
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "part").nodes.withColumn("vector", embedding.feature_hash(F.col("data.p_name"), 64))
    return vector.search_text(n, "part", 10, lambda t: embedding.embed(t, 64)).withColumn("score", _r("score"))


@query("SELECT NULL::VARCHAR AS id, NULL::DOUBLE AS score WHERE false")
def search_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "part").nodes.withColumn("vector", embedding.feature_hash(F.col("data.p_name"), 64))
    return vector.search_text(n, "", 10, lambda t: embedding.embed(t, 64))


@query("SELECT 'customer:' || c_custkey || '::IN_NATION::nation:' || c_nationkey AS id FROM customer")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "nation").edges.where("type = 'IN_NATION'").select(scalar.edge_id(F.regexp_replace("source", "::", ":"), F.col("type"), F.col("target")).alias("id"))


# Mutations

@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey <= 10 THEN 0.0 ELSE c_acctbal END AS balance, CAST(CASE WHEN c_custkey <= 10 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM customer")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer")
    rows = g.nodes.where("data.c_custkey <= 10").withColumn("data", F.col("data").withField("c_acctbal", F.lit(0.0)))
    out = mutate.upsert_nodes(g, rows, NOW)
    return out.nodes.select("id", F.col("data.c_acctbal").alias("balance"), "revision")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_nationkey <= 4 THEN c_nationkey + 0.5 ELSE c_acctbal END AS balance, CAST(CASE WHEN c_nationkey <= 4 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM customer")
def upsert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row comes three times in the batch; the last counts."""
    g = graph(spark, sf_dir, "customer")
    own = g.nodes.where("data.c_nationkey <= 4")
    times = [own.withColumn("data", F.col("data").withField("c_acctbal", x)) for x in (F.lit(1.0), F.lit(2.0), F.col("data.c_nationkey") + 0.5)]
    out = mutate.upsert_nodes(g, times[0].unionByName(times[1]).unionByName(times[2]), NOW)
    return out.nodes.select("id", F.col("data.c_acctbal").alias("balance"), "revision")


@query("SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'last' ELSE n_name END AS name, CAST(CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM nation")
def update_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes of each node; the last counts and no node is doubled."""
    g = graph(spark, sf_dir, "nation")
    own = g.nodes.where("data.n_regionkey = 2").select("id")
    changes = own.withColumn("n_name", F.lit("first")).unionByName(own.withColumn("n_name", F.lit("last")))
    out = mutate.update_nodes(g, changes, NOW)
    return out.nodes.select("id", F.col("data.n_name").alias("name"), "revision")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'PATCHED' ELSE c_mktsegment END AS segment, round(CASE WHEN c_custkey = 1 THEN c_acctbal + 5 ELSE c_acctbal END, 2) AS balance, CASE WHEN c_custkey = 1 THEN NULL ELSE c_name END AS name FROM customer")
def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer")
    one = g.nodes.where("id = 'customer:1'").select("id")
    out = mutate.patch_nodes(g, one, NOW, set_={"data.c_mktsegment": "PATCHED"}, unset=["data.c_name"], increment={"c_acctbal": 5})
    return out.nodes.select("id", F.col("data.c_mktsegment").alias("segment"), _r("data.c_acctbal", 2).alias("balance"), F.col("data.c_name").alias("name"))


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'ABROAD' ELSE c_mktsegment END AS segment FROM customer")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer")
    out = mutate.update_nodes(g, g.nodes.where("data.c_nationkey = 3").select("id", F.lit("ABROAD").alias("c_mktsegment")), NOW)
    return out.nodes.select("id", F.col("data.c_mktsegment").alias("segment"))


@query("""SELECT type, count(*) AS count FROM (SELECT 'region' AS type FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation' FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2) GROUP BY type""")
def remove_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions own their nations and these their customers: removing a region takes them along."""
    g = graph(spark, sf_dir, "customer", "nation", "region")
    owned = g.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("OWNS_"), "type").alias("type"), F.lit("owned").alias("ownership"))
    g = Graph.of(g.nodes, owned)
    left, _ = mutate.remove_nodes(g, g.nodes.where("id = 'region:2'").select("id"))
    return left.nodes.groupBy("type").count()


@query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1")
def remove_edges_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "nation", "region")
    shared = Graph.of(g.nodes, g.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("SHARES").alias("type"), F.lit("shared").alias("ownership")))
    return mutate.remove_edges(shared, F.col("source") == "region:1")[2]


@query("SELECT min('customer:' || c_custkey) AS id, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def unique_index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "customer").nodes.where("type = 'customer'")
    return mutate.Index("nation", ("c_nationkey",), unique=True).violations(n)


@query("SELECT 'customer:' || o_custkey AS id, 'one-to-one: source' AS problem FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.EdgeSchema("PLACED", cardinality="one-to-one").violations(graph(spark, sf_dir, "customer", "orders"))


@query("SELECT CAST(0 AS BIGINT) AS problems")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "orders").verify().agg(F.count("*").alias("problems"))


@query("""SELECT 'edge source without a node' AS problem, (SELECT count(*) FROM orders WHERE o_custkey <= 50) AS n
UNION ALL SELECT 'repeated node id', (SELECT count(*) FROM orders WHERE o_custkey > 50 AND o_custkey <= 60)""")
def verify_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers taken away and the orders of others doubled: both are found, and nothing else."""
    g = graph(spark, sf_dir, "customer", "orders")
    nodes = g.nodes.where("data.c_custkey is null or data.c_custkey > 50")
    twice = nodes.where("data.o_custkey > 50 and data.o_custkey <= 60")
    return Graph(nodes.unionByName(twice), g.edges).verify()


@query("SELECT count(*) AS n FROM customer")
def count_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph(spark, sf_dir, "customer", "nation").count_of_type("customer"),)], "n bigint")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS nodes, CAST(0 AS BIGINT) AS vectors, CAST(0 AS BIGINT) AS activated, CAST(2 AS BIGINT) AS types, (SELECT count(*) FROM orders) AS edges")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer", "orders").stats()


# Store, log, migration, streams

def _folder(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodegraph-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, _folder(spark, "store"))
    g = graph(spark, sf_dir, "customer", "nation")
    store.save(g)
    some = g.nodes.where("data.c_custkey <= 20").withColumn("data", F.col("data").withField("c_acctbal", F.lit(1.5))).withColumn("revision", F.col("revision") + 1)
    store.commit(put_nodes=some, timestamp=NOW, operation_id="zero")
    store.commit(put_nodes=some, timestamp=NOW, operation_id="zero")  # known: changes nothing
    store.commit(delete_nodes=g.nodes.where("data.c_custkey > 100").select("id"), timestamp=NOW + 1, operation_id="drop")
    return store


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey <= 20 THEN 1.5 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey <= 100")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).load().nodes.where("type = 'customer'").select("id", F.col("data.c_acctbal").alias("balance"))


@query("SELECT count(*) AS n, least(greatest(count(*) - 5, 0), 25) AS paged FROM customer WHERE c_custkey <= 100 AND CASE WHEN c_custkey <= 20 THEN 1.5 ELSE c_acctbal END > 1")
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted on a store with deltas: the predicate sees the rows they put, and not those they removed."""
    store = _stored(spark, sf_dir)
    return spark.createDataFrame([(store.count("data.c_acctbal > 1", "customer"), store.count("data.c_acctbal > 1", "customer", 5, 25))], "n bigint, paged bigint")


@query("SELECT CAST(1 AS BIGINT) AS sequence, 'putNode' AS op, count(*) AS n FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 2, 'deleteNode', count(*) FROM customer WHERE c_custkey > 100")
def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.changes(_stored(spark, sf_dir).log_since(0)).groupBy("sequence", "op").agg(F.count("*").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 25 OFFSET 10")
def persisted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "store")
    Store(spark, path).save(graph(spark, sf_dir, "customer"))
    return scan(spark, path, "type = 'customer' and data.c_acctbal > 0", ["_seq"], 10, 25).select("id")


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS title FROM nation")
def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = migrate.migrate(graph(spark, sf_dir, "nation"), [migrate.Step(1, nodes=migrate.renamed("n_name", "title"))], 1, 2)
    return out.nodes.select("id", F.col("data.title").alias("title"))


@query("SELECT 'event:' || event_id AS id, CAST(0.02 AS DOUBLE) AS delta FROM events WHERE event_type = 'purchase'")
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clients' deltas add up; a batch sent again, whole or in part, changes nothing."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    ops = lambda client: own.select(F.lit(client).alias("client_id"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("operation_id"), F.lit(None).cast("string").alias("transaction_id"), F.lit(NOW).cast("long").alias("timestamp"), F.lit("activationUpdate").alias("kind"), F.to_json(F.struct(F.concat(F.lit("event:"), F.col("event_id")).alias("id"), F.lit(0.01).alias("delta"))).alias("payload"))
    server = feed.SyncServer(spark, _folder(spark, "sync"))
    server.submit(ops("a"), 0)
    server.submit(ops("a"), 1)
    server.submit(ops("b").unionByName(ops("a").limit(5)), 2)
    return feed.activation_totals(server.ops()).withColumn("delta", _r("delta"))


# Further operators of the same groups

@query("SELECT greatest(0, least(count(*) - 10, 25)) AS n FROM part")
def count_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "part").query().offset(10).limit(25).count()
    return spark.createDataFrame([(n,)], "n bigint")


@query("SELECT 'part:' || p_partkey AS id FROM part ORDER BY p_retailprice, p_partkey LIMIT 1")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(graph(spark, sf_dir, "part").query().order_by("p_retailprice").first()["id"],)], "id string")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice > 920 ORDER BY p_size DESC, p_partkey LIMIT 30")
def plan_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodegraph.operators.query import GraphQuery

    attributes = [{"field": "p_size", "operator": "range", "above": 10}, {"field": "p_size", "operator": "range", "below": 20}, {"field": "p_retailprice", "operator": "range", "above": 920}]
    plan = {"nodeTypes": ["part"], "attributes": attributes, "order": {"field": "p_size", "direction": "desc"}, "limit": 30}
    return GraphQuery.from_plan(graph(spark, sf_dir, "part"), plan).ids()


@query("SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def edges_by_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer", "orders")
    return g.edges_by(g.nodes.where("data.c_nationkey = 7"), "source", "PLACED").select("source", "target")


@query("SELECT 'part:' || l_partkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey = 5 GROUP BY 1")
def edge_targets_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "orders", "part", "lineitem").targets("order:5", "CONTAINS").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'order:' || l_orderkey AS id FROM lineitem WHERE l_partkey = 5")
def edge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "orders", "part", "lineitem").sources("part:5", "CONTAINS")


@query("""SELECT 'order:' || o_orderkey AS id, 0.5::DOUBLE AS spread FROM orders WHERE o_custkey = 4 UNION ALL
SELECT DISTINCT 'part:' || l_partkey, 0.25::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 4""")
def spread_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer", "orders", "part", "supplier", "lineitem")
    return Activation().spread(g, g.nodes.where("id = 'customer:4'"), edge_types=["PLACED", "CONTAINS"]).select("id", "spread")


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(0.5 + pow(0.5::DOUBLE, ({_CLOCK} - t) / {float(7 * S.DAY)}) + s / 2, 6) AS total FROM e""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "events").nodes.where("type = 'event'")
    return Activation().breakdown(n, _clock(spark, sf_dir), F.lit(0.5), F.lit(None).cast("double")).select("id", _r("total").alias("total"))


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS id, round(CASE WHEN event_type = 'view' THEN 0.4 ELSE {_DECAYED.format(now=_CLOCK)} END, 6) AS effective FROM e WHERE event_type <> 'error'""")
def effective_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, now = graph(spark, sf_dir, "events"), _clock(spark, sf_dir)
    views = g.nodes.where("data.event_type = 'view'").select("id", F.lit(0.4).alias("delta"))
    seen = activation.reinforce(g, views, now, context="work").nodes.where("type = 'event' and data.event_type != 'error'")
    return Activation().effective(seen, now, "work").select("id", _r("effective").alias("effective"))


@query("SELECT 'region:' || r_regionkey AS id, CAST(ceil(length(to_json({'id': 'region:' || r_regionkey, 'type': 'region', 'data': {'r_regionkey': r_regionkey, 'r_name': r_name}})) / 4.0) AS BIGINT) AS tokens FROM region")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph(spark, sf_dir, "region").nodes
    return n.select("id", scalar.estimate_tokens(F.col("id"), F.col("type"), F.col("data")).alias("tokens"))


@query("SELECT 'event:' || event_id AS id FROM events ORDER BY floor(epoch_us(ts) / 1000.0) DESC, event_id DESC LIMIT 100")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "events")
    return mutate.prune(Graph(g.nodes.where("type = 'event'"), g.edges.limit(0)), 100)[0].nodes.select("id")


@query("SELECT 'item:' || vec_id AS id, label = 3 AS removed FROM embeddings")
def remove_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "embeddings")
    out = mutate.set_vectors(g, g.nodes.where("data.label = 3").select("id", F.lit(None).cast("array<double>").alias("vector")))
    return out.nodes.select("id", F.col("vector").isNull().alias("removed"))


@query("SELECT count(*) AS edges FROM orders")
def add_known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding edges whose ids exist changes nothing."""
    g = graph(spark, sf_dir, "customer", "orders")
    return mutate.add_edges(g, g.edges, NOW).edges.agg(F.count("*").alias("edges"))


@query("SELECT 'customer:' || c_custkey AS source, CASE WHEN c_nationkey = 2 THEN 'home' ELSE 'abroad' END AS kind FROM customer")
def update_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "customer", "nation")
    g = Graph(g.nodes, g.edges.withColumn("data", F.struct(F.lit("abroad").alias("kind"), F.lit(1).alias("weight"))))
    out = mutate.update_edges(g, g.edges.where("target = 'nation:2'").select("id", F.lit("home").alias("kind")))
    return out.edges.select("source", F.col("data.kind").alias("kind"))


@query("SELECT 'customer' AS type, count(*) AS count FROM customer")
def delete_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.delete_by_type(graph(spark, sf_dir, "customer", "nation"), "nation")[0].nodes.groupBy("type").count()


@query("SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'nation:0' END AS supersedes, CASE WHEN n_nationkey = 0 THEN 1.0::DOUBLE END AS inhibition FROM nation")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mutate.supersede(graph(spark, sf_dir, "nation"), "nation:1", "nation:0", NOW)
    return out.nodes.select("id", "supersedes", F.col("activation.inhibition").alias("inhibition"))


@query("SELECT 'summary' AS source, 'nation:' || n_nationkey AS target FROM nation WHERE n_nationkey < 3")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "nation")
    new = g.nodes.where("id = 'nation:0'").withColumn("id", F.lit("summary"))
    return mutate.consolidate(g, new, ["nation:0", "nation:1", "nation:2"], NOW).edges.where("type = 'CONSOLIDATES'").select("source", "target")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE NOT c_acctbal > 0")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = mutate.NodeSchema("customer", ("c_name",), {"c_acctbal": "number", "c_name": "string"}, F.col("data.c_acctbal") > 0)
    return rule.violations(graph(spark, sf_dir, "customer").nodes).select("id")


@query("SELECT 'customer:' || c_custkey || '::IN_NATION::nation:' || c_nationkey AS id, 'source type' AS problem FROM customer")
def endpoint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.EdgeSchema("IN_NATION", source_types=("supplier",), target_types=("nation",)).violations(graph(spark, sf_dir, "customer", "nation"))


@query("SELECT count(*) + 1 AS nodes FROM nation")
def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction commits, one that fails leaves the graph as it was."""
    g = graph(spark, sf_dir, "nation")
    new = g.nodes.where("id = 'nation:0'").withColumn("id", F.lit("nation:new"))
    with mutate.Transaction(g) as t:
        t.graph = mutate.upsert_nodes(t.graph, new, NOW)
    kept = t.graph
    try:
        with mutate.Transaction(kept) as t:
            t.graph = mutate.delete_by_type(t.graph, "nation")[0]
            raise S.Conflict("rolled back")
    except S.Conflict:
        pass
    return t.graph.nodes.agg(F.count("*").alias("nodes"))


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey <= 20 THEN 1.5 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey <= 100")
def store_compact_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = _stored(spark, sf_dir).copy_to(_folder(spark, "backup"))
    copy.compact(0)
    return copy.load().nodes.where("type = 'customer'").select("id", F.col("data.c_acctbal").alias("balance"))


@query("SELECT CAST(2 AS BIGINT) AS sequence, 'drop' AS operation_id")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.retain(NOW, max_entries=1)
    return store.log().select("sequence", "operation_id")


@query("SELECT 'item:' || vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, _folder(spark, "store"))
    store.save(graph(spark, sf_dir, "embeddings"))
    store.to_precision("float")
    return store.load().nodes.select("id", _r(F.col("vector")[0]).alias("first"))


@query("SELECT 'putNode' AS op, count(*) AS n FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 'deleteNode', count(*) FROM customer WHERE c_custkey > 100")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream, its changes written once each."""
    store, out = _stored(spark, sf_dir), _folder(spark, "changes")
    stream = feed.changes(feed.read_log(spark, store.path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("sequence bigint, timestamp bigint, op string, id string, revision bigint").parquet(out).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, rank AS cursor FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events WHERE event_type = 'signup') WHERE rank > 5 AND rank <= 15")
def sync_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    server = feed.SyncServer(spark, _folder(spark, "sync"), max_batch=10)
    server.submit(own.select(F.lit("a").alias("client_id"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("operation_id"), F.lit(None).cast("string").alias("transaction_id"), F.lit(NOW).cast("long").alias("timestamp"), F.lit("addNode").alias("kind"), F.lit("{}").alias("payload")), 0)
    return server.since(5, "b").select("seq", "cursor")
