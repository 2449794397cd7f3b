"""Upserts, patches, ownership, constraints, store, migrations and sync."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions.embedding import embed, feature_hash, word_slot
from lodegraph.operators import activation, mutate, vector
from lodegraph.operators.activation import Activation
from lodegraph.operators.graph import Graph
from lodegraph.sources import migrate
from lodegraph.sources.store import Store, page_count, require
from lodegraph.streaming import feed


def nodes(spark, *rows):
    raw = spark.createDataFrame([(i, t, n, a) for i, t, n, a in rows], "id string, type string, name string, age int")
    return raw.select("id", "type", F.struct("name", "age").alias("data"))


def people(spark):
    return Graph.of(nodes(spark, ("p1", "person", "Ada", 36), ("p2", "person", "Bob", 40)), spark.createDataFrame([("p1", "KNOWS", "p2")], "source string, type string, target string"))


def owned(spark, ids, edges):
    e = spark.createDataFrame([(a, f"E{i}", b, k) for i, (a, b, k) in enumerate(edges)], "source string, type string, target string, ownership string")
    return Graph.of(nodes(spark, *((i, "t", i, 1) for i in ids)), e)


def left(g):
    return sorted(r["id"] for r in g.nodes.select("id").collect())


def test_upsert(spark):
    g = people(spark)
    out = mutate.upsert_nodes(g, nodes(spark, ("p1", "person", "Ada L", 37), ("p3", "person", "Cy", 1)), 5)
    rows = {r["id"]: r for r in out.nodes.collect()}
    assert (rows["p1"]["revision"], rows["p1"]["data"]["name"], rows["p3"]["revision"], rows["p3"]["inserted_at"]) == (1, "Ada L", 0, 5)
    with pytest.raises(S.Conflict):
        mutate.upsert_nodes(g, nodes(spark, ("p1", "person", "x", 1)), 5, expected_revision=3)
    with pytest.raises(S.ResourceLimit):
        mutate.upsert_nodes(g, nodes(spark, ("a", "t", "x", 1), ("b", "t", "x", 1)), 5, checks=[mutate.within_limits(max_batch=1)])
    with pytest.raises(S.ResourceLimit):
        mutate.upsert_nodes(g, nodes(spark, ("a", "t", "x" * 50, 1)), 5, checks=[mutate.within_limits(max_payload_bytes=20)])


def test_patch(spark):
    g = people(spark)
    one = spark.createDataFrame([("p1",)], "id string")
    out = mutate.patch_nodes(g, one, 9, compare_and_set={"name": ("Ada", "A")}, increment={"data.age": 4})
    row = out.nodes.where("id = 'p1'").first()
    assert (row["data"]["name"], row["data"]["age"], row["revision"]) == ("A", 40, 1)
    assert mutate.patch_nodes(g, one, 9, unset=["data.age"]).nodes.where("id = 'p1'").first()["data"]["age"] is None
    with pytest.raises(S.Conflict):
        mutate.patch_nodes(g, one, 9, compare_and_set={"name": ("Eve", "A")}, set_={"age": 1})
    with pytest.raises(S.NotFound):
        mutate.patch_nodes(g, spark.createDataFrame([("zz",)], "id string"), 9, set_={"age": 1})
    assert g.nodes.where("id = 'p1'").first()["data"]["age"] == 36


def test_edges(spark):
    g = people(spark)
    again = mutate.add_edges(g, spark.createDataFrame([("p1", "KNOWS", "p2"), ("p2", "KNOWS", "p1")], "source string, type string, target string"), 1)
    assert again.edges.count() == 2
    parallel = mutate.add_edges(g, spark.createDataFrame([("other", "p1", "KNOWS", "p2")], "id string, source string, type string, target string"), 1)
    assert [r["id"] for r in parallel.targets("p1", "KNOWS").collect()] == ["p2", "p2"]
    assert [r["id"] for r in parallel.sources("p2", "KNOWS").collect()] == ["p1"]


@pytest.mark.parametrize(
    ("ids", "edges", "gone", "stay"),
    [
        ("ABC", [("A", "B", "owned"), ("B", "C", "owned")], "A", []),
        ("ABC", [("A", "C", "owned"), ("B", "C", "owned")], "A", ["B", "C"]),
        ("ABC", [("A", "B", "owned"), ("A", "C", "owned"), ("C", "B", "owned")], "A", []),
        ("ABC", [("A", "B", "owned"), ("B", "A", "owned"), ("A", "C", "reference")], "A", ["C"]),
        ("AB", [("A", "B", "shared")], "A", ["B"]),
    ],
)
def test_cascades(spark, ids, edges, gone, stay):
    g = owned(spark, ids, edges)
    after, removed = mutate.remove_nodes(g, spark.createDataFrame([(gone,)], "id string"))
    assert left(after) == stay
    assert sorted(r["id"] for r in removed.collect()) == sorted(set(ids) - set(stay))


def test_cascades_reach_the_fixpoint_of_brute_force(spark):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(25)]
    edges = [(rng.choice(ids), rng.choice(ids), "owned") for _ in range(30)]
    g = owned(spark, ids, edges)
    removed = {r["id"] for r in mutate.cascade(g, spark.createDataFrame([("n0",), ("n1",)], "id string")).collect()}
    want = {"n0", "n1"}
    while new := {b for _, b, _ in edges if b not in want and all(x in want for x, y, _ in edges if y == b)}:
        want |= new
    assert removed == want


def test_removed_edges(spark):
    g = owned(spark, "ABCD", [("A", "B", "owned"), ("A", "C", "shared"), ("B", "D", "owned")])
    after, gone, orphans = mutate.remove_edges(g, F.col("source") == "A")
    assert left(after) == ["A", "C"] and sorted(r["id"] for r in gone.collect()) == ["B", "D"] and [r["id"] for r in orphans.collect()] == ["C"]


def test_constraints(spark):
    g = people(spark)
    mutate.NodeSchema("person", ("name",), {"name": "string", "age": "integer"})(g.nodes)
    with pytest.raises(S.GraphError):
        mutate.NodeSchema("person", ("name",), {"age": "string"})(g.nodes)
    with pytest.raises(S.GraphError):
        mutate.NodeSchema("person", validate=F.col("data.age") > 38)(g.nodes)
    mutate.EdgeSchema("KNOWS", ("person",), ("person",), "one-to-one")(g)
    with pytest.raises(S.GraphError):
        mutate.EdgeSchema("KNOWS", target_types=("book",))(g)
    mutate.Index("name", ("name",), unique=True)(g.nodes)
    twice = mutate.upsert_nodes(g, nodes(spark, ("p3", "person", "Ada", 1)), 1)
    with pytest.raises(S.Conflict):
        mutate.Index("name", ("name",), unique=True)(twice.nodes)
    with pytest.raises(S.GraphError):
        mutate.valid_provenance(g.nodes.withColumn("confidence", F.lit(2.0)))
    assert g.verify().count() == 0
    assert {r["problem"] for r in Graph(g.nodes.where("id = 'p1'"), g.edges).verify().collect()} == {"edge target without a node"}


def test_transactions(spark):
    g = people(spark)
    with mutate.Transaction(g, [mutate.EdgeSchema("KNOWS", ("person",))]) as t:
        t.graph = mutate.upsert_nodes(t.graph, nodes(spark, ("p9", "person", "Z", 1)), 1)
    assert "p9" in left(t.graph)
    with pytest.raises(RuntimeError), mutate.Transaction(g) as t:
        t.graph = mutate.delete_by_type(t.graph, "person")[0]
        raise RuntimeError
    assert left(t.graph) == ["p1", "p2"]


def test_supersede_and_consolidate(spark):
    g = people(spark)
    out = mutate.supersede(g, "p2", "p1", 10)
    row = {r["id"]: r for r in out.nodes.collect()}
    assert row["p2"]["supersedes"] == "p1" and row["p1"]["activation"]["inhibition"] == 1.0
    assert out.out_edges("p1", "SUPERSEDED_BY").first()["target"] == "p2"
    both = mutate.consolidate(g, nodes(spark, ("c", "person", "both", 1)), ["p1", "p2", "p1"], 10)
    assert both.nodes.where("id = 'c'").first()["derived_from"] == ["p1", "p2"] and both.edges.where("source = 'c'").count() == 2
    assert mutate.consolidate(g, nodes(spark, ("c", "person", "both", 1)), ["p1", "gone"], 10) is g


def test_working_memory_stops_at_the_budget(spark):
    g = people(spark)
    lit = activation.reinforce(g, spark.createDataFrame([("p1", 0.9), ("p2", 0.5)], "id string, delta double"), 0)
    engine = Activation()
    assert [r["id"] for r in engine.working_memory(lit.nodes, 0)] == ["p1", "p2"]
    assert [r["id"] for r in engine.working_memory(lit.nodes, 0, token_budget=5, cost_of=lambda r: 10 if r["id"] == "p1" else 1)] == []
    assert engine.with_feedback({"semantic": 1.0}, False).weights["semantic"] == 0.95
    calm, due = engine.with_attention({"p1": 0.01, "p2": 0.2})
    assert due == {"p2": 0.2} and calm.attention == {"p1": 0.01}


def test_store(spark, tmp_path):
    g, store = people(spark), Store(spark, str(tmp_path / "s"))
    store.save(g)
    first = store.manifest()
    new = g.nodes.where("id = 'p1'").withColumn("revision", F.lit(1).cast("long"))
    store.commit(put_nodes=new, timestamp=1, operation_id="a", transaction_id="t", actor="me", metadata={"k": "v"})
    store.commit(delete_nodes=new.select("id"), timestamp=2, operation_id="a")
    assert left(store.load()) == ["p1", "p2"] and store.latest_sequence() == 1
    store.commit(delete_nodes=new.select("id"), timestamp=2, operation_id="b", base_sequence=1)
    assert left(store.load()) == ["p2"] and left(store.load(first)) == ["p1", "p2"]
    with pytest.raises(S.Conflict):
        store.commit(delete_nodes=new.select("id"), timestamp=2, base_sequence=1)
    log = store.log_since(0).collect()
    assert [(r["sequence"], r["operation_id"], [o["op"] for o in r["operations"]]) for r in log] == [(1, "a", ["putNode"]), (2, "b", ["deleteNode"])]
    copy = store.copy_to(str(tmp_path / "copy"))
    store.compact()
    assert left(store.load()) == left(copy.load()) == ["p2"] and len(store.manifest().nodes) == 1
    store.retain(10, max_entries=1)
    assert [r["sequence"] for r in store.log().collect()] == [2]
    stale = store.manifest()
    with pytest.raises(S.Conflict):
        store._publish(stale)
    assert page_count(10, 4, 3) == 3 and page_count(3, 4) == 0
    require("transactions")


def test_migration(spark):
    g = people(spark)
    out, report = migrate.migrate(g, [migrate.Step(1, nodes=migrate.renamed("name", "label"))], 1, 2)
    assert out.nodes.where("id = 'p1'").first()["data"]["label"] == "Ada" and report.first()["nodes"] == 2
    assert migrate.migrate(g, [migrate.Step(1, nodes=migrate.renamed("name", "label"))], 1, 2, dry_run=True)[0] is g
    with pytest.raises(S.GraphError):
        migrate.migrate(g, [migrate.Step(2)], 1, 3)
    with pytest.raises(S.Conflict):
        migrate.migrate(g, [migrate.Step(1, nodes=lambda df: df.withColumn("id", F.lit("x")))], 1, 2)
    assert [b.first()["id"] for b in migrate.in_batches(g.nodes, 1)] == ["p1", "p2"]


def test_checksums():
    ops = [
        {"seq": 1, "timestamp": 1700000000000, "clientId": "writer-a", "kind": "addNode", "payload": {"id": "person-1", "type": "person"}, "operationId": "op-1", "transactionId": "tx-1", "baseRevision": 0},
        {"seq": 2, "timestamp": 1700000000001, "clientId": "writer-a", "kind": "updateNode", "payload": {"id": "person-1", "data": {"name": "Ada"}}, "operationId": "op-2", "transactionId": "tx-1", "baseRevision": 0},
    ]
    assert feed.checksum(ops) == "c202c42e"
    assert feed.identity_checksum(["writer-a:op-1", "writer-a:op-2"], ["writer-a:tx-1"]) == "234cf880"


def op(client, seq, kind="activationUpdate", node="p1", delta=0.2, operation=None, tx=None):
    return (client, seq, operation, tx, 1, kind, f'{{"id": "{node}", "delta": {delta}}}')


def test_sync(spark, tmp_path):
    server = feed.SyncServer(spark, str(tmp_path / "sync"), accept=lambda df: F.col("client_id") != "bad")
    make = lambda *rows: spark.createDataFrame(rows, feed.OPS)
    server.submit(make(op("a", 1), op("a", 2, operation="x"), op("bad", 1)), 0)
    server.submit(make(op("a", 1), op("b", 1, delta=0.3)), 1)
    server.submit(make(op("b", 1, delta=0.3)), 1)
    server.submit(make(op("a", 7, operation="x"), op("c", 1, tx="t"), op("c", 2, kind="nonsense", tx="t")), 2)
    assert [r["cursor"] for r in server.since(0).collect()] == [1, 2, 3]
    assert [r["client_id"] for r in server.since(0, "a").collect()] == ["b"]
    g = feed.apply_activation(people(spark), server.ops(), 5)
    assert g.nodes.where("id = 'p1'").first()["activation"]["score"] == pytest.approx(0.7)
    with pytest.raises(S.GraphError):
        feed.SyncServer(spark, server.path, max_ops=1).since(0)


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(people(spark))
    store.commit(put_nodes=people(spark).nodes, timestamp=1, operation_id="a")
    seen = []
    query = feed.on_change(feed.read_log(spark, store.path), lambda rows: seen.extend(r["id"] for r in rows.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == ["p1", "p2"]


def test_embedding():
    v = embed("Graph graph 数据", 16)
    assert sum(x * x for x in v) == pytest.approx(1.0) and embed("...", 4) == [0.0] * 4
    assert v[word_slot("graph", 16)] > 0


def test_the_last_of_repeated_ids_counts(spark):
    g = Graph.of(spark.createDataFrame([("a", "t", (1,)), ("b", "t", (2,))], "id string, type string, data struct<x: int>"), spark.createDataFrame([("e", "a", "L", "b")], "id string, source string, type string, target string"))
    rows = spark.createDataFrame([("c", "t", (5,)), ("b", "t", (6,)), ("d", "t", (7,)), ("b", "t", (8,)), ("c", "t", (9,))], "id string, type string, data struct<x: int>").coalesce(1)
    out = mutate.upsert_nodes(g, rows, 10).nodes
    assert [(r["id"], r["data"]["x"], r["revision"]) for r in out.orderBy("_seq").collect()] == [("a", 1, 0), ("b", 8, 1), ("d", 7, 0), ("c", 9, 0)]
    changed = mutate.update_nodes(g, spark.createDataFrame([("a", 3), ("a", 4), ("z", 1)], "id string, x int").coalesce(1), 10).nodes
    assert sorted((r["id"], r["data"]["x"], r["revision"]) for r in changed.collect()) == [("a", 4, 1), ("b", 2, 0)]
    vectors = mutate.set_vectors(g, spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "id string, vector array<double>").coalesce(1)).nodes
    assert sorted((r["id"], r["vector"]) for r in vectors.collect()) == [("a", [2.0]), ("b", None)]
    edges = mutate.add_edges(g, spark.createDataFrame([("f", "b", "L", "a"), ("f", "b", "M", "a"), ("e", "b", "L", "b")], "id string, source string, type string, target string").coalesce(1), 10).edges
    assert sorted((r["id"], r["type"], r["target"]) for r in edges.collect()) == [("e", "L", "b"), ("f", "M", "a")]


def test_upsert_with_embedding(spark):
    g = Graph.of(spark.createDataFrame([("a", "t", ("x",))], "id string, type string, data struct<x: string>"), spark.createDataFrame([], "source string, type string, target string"))
    rows = spark.createDataFrame([("b", "t", ("one two",)), ("c", "t", (None,))], "id string, type string, data struct<x: string>")
    out = {r["id"]: r["vector"] for r in mutate.upsert_embedded(g, rows, F.col("data.x"), 10, lambda t: feature_hash(t, 8), dimensions=8).nodes.collect()}
    assert out["a"] is None and out["c"] is None and out["b"] == pytest.approx(embed("one two", 8))
    with pytest.raises(S.DimensionMismatch):
        mutate.upsert_embedded(g, rows, F.col("data.x"), 10, lambda t: feature_hash(t, 8), dimensions=9)
    with pytest.raises(S.GraphError):
        mutate.upsert_embedded(g, rows, F.col("data.x"), 10, lambda t: F.array(F.lit(float("nan"))))


def test_text_search(spark):
    nodes = mutate.upsert_embedded(Graph.of(spark.createDataFrame([], "id string, type string, data struct<x: string>"), spark.createDataFrame([], "source string, type string, target string")), spark.createDataFrame([("b", "t", ("red apple",)), ("c", "t", ("green pear",))], "id string, type string, data struct<x: string>"), F.col("data.x"), 10).nodes
    assert [r["id"] for r in vector.search_text(nodes, "apple", 1).collect()] == ["b"]
    assert vector.search_text(nodes, "", 5).count() == vector.search_text(nodes, "?!", 5).count() == 0


def test_a_large_commit_has_records_of_bounded_size(spark, tmp_path, monkeypatch):
    from lodegraph.sources import store as module

    monkeypatch.setattr(module, "LOG_ROWS", 10)
    store = module.Store(spark, str(tmp_path / "s"))
    rows = spark.range(100).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("t").alias("type"), F.struct(F.col("id").alias("x")).alias("data"))
    empty = spark.createDataFrame([], "source string, type string, target string")
    store.save(Graph.of(rows, empty))
    store.commit(put_nodes=store.load().nodes.where("data.x < 55"), timestamp=1)
    store.commit(delete_nodes=rows.where("data.x < 3").select("id"), timestamp=2)
    log = store.log().collect()
    assert sorted({r["sequence"] for r in log}) == [1, 2] and 3 <= sum(r["sequence"] == 1 for r in log) <= 6
    assert sorted(o["id"] for r in log for o in r["operations"] if r["sequence"] == 1) == sorted(f"n{i}" for i in range(55))
    assert {r["sequence"] for r in store.log_since(0, limit=1).collect()} == {1}
    assert store.count() == 97 and store.count("data.x < 10", "t") == 7 and store.count(limit=5, offset=95) == 2
    plan = store.load().nodes.where("type = 't'")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "PartitionFilters: [isnotnull(type" in plan


def test_cursors_of_a_batch_over_many_ranges(spark, tmp_path):
    from lodegraph.streaming import feed

    server = feed.SyncServer(spark, str(tmp_path / "sync"), max_batch=5000)
    own = spark.range(3000, numPartitions=7).select(F.lit("a").alias("client_id"), "id", F.lit(None).cast("string").alias("operation_id"), F.lit(None).cast("string").alias("transaction_id"), (F.col("id") * 7919 % 3001).alias("timestamp"), F.lit("addNode").alias("kind"), F.lit("{}").alias("payload")).withColumnRenamed("id", "seq")
    server.submit(own.where("seq < 1000"), 0)
    server.submit(own, 1)
    got = [(r["cursor"], r["timestamp"], r["seq"]) for r in server.since(0).collect()]
    assert [c for c, *_ in got] == list(range(1, 3001))
    assert [x[1:] for x in got[:1000]] == sorted(x[1:] for x in got[:1000]) and [x[1:] for x in got[1000:]] == sorted(x[1:] for x in got[1000:])
