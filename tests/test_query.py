"""The query builder and its terminals on a small library of books, by struct and by variant."""

import pytest
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.operators import traverse
from lodegraph.operators.graph import Graph
from lodegraph.operators.query import GraphQuery
from lodegraph.plans import plan as P

BOOKS = [("b1", "Neuromancer", "sci-fi", 5, 12.0), ("b2", "Dune", "sci-fi", 4, 15.0), ("b3", "LotR", "fantasy", 5, 20.0), ("b4", "Name of the Wind", "fantasy", 4, 14.0), ("b5", "Pride", "romance", 5, 10.0)]
VECTORS = {"b1": [1.0, 0.0], "b2": [0.9, 0.1], "b3": [0.0, 1.0], "b4": [0.1, 0.9]}


@pytest.fixture(scope="module", params=["struct", "variant"])
def graph(request, spark):
    rows = [(i, "book", t, g, r, p, None, VECTORS.get(i), n) for n, (i, t, g, r, p) in enumerate(BOOKS)] + [("u1", "user", None, None, None, None, "Alice", None, 5), ("u2", "user", None, None, None, None, "Bob", None, 6)]
    raw = spark.createDataFrame(rows, "id string, type string, title string, genre string, rating int, price double, name string, vector array<double>, _seq bigint")
    data = F.struct("title", "genre", "rating", "price", "name")
    if request.param == "variant":
        data = F.parse_json(F.to_json(data))
    edges = spark.createDataFrame([("u1", "RATED", "b1", 0), ("u1", "RATED", "b2", 1), ("u2", "RATED", "b3", 2), ("u1", "FOLLOWS", "u2", 3), ("u2", "RATED", "gone", 4)], "source string, type string, target string, _seq bigint")
    return Graph.of(raw.select("id", "type", data.alias("data"), "vector", "_seq"), edges)


def ids(q):
    return [r["id"] for r in q.to_list()]


def test_filters(graph):
    q = graph.query()
    assert sorted(ids(q.where("genre", "sci-fi"))) == ["b1", "b2"]
    assert ids(q.where("genre", "sci-fi").where("genre", "romance")) == ["b5"]
    assert ids(q.where("rating", "5")) == []
    assert sorted(ids(q.where("data.rating", 5).where_attribute_range("price", above=10, below=20))) == ["b1"]
    assert ids(q.where_node_type()) == []
    assert sorted(ids(q.where("type", "user"))) == ["u1", "u2"]
    assert ids(q.where("nothing", 1)) == []
    with pytest.raises(S.GraphError):
        q.where_attribute_range("price", above=float("nan"))


def test_edges_and_joins(graph):
    q = graph.query()
    assert sorted(ids(q.where_edge("RATED"))) == ["u1", "u2"]
    assert ids(q.where_edge("RATED", "b3")) == ["u2"]
    assert sorted(ids(q.where_edge_source("u1"))) == ["b1", "b2", "u2"]
    assert ids(q.where_edge("RATED").where_edge_source("u1")) == []
    assert sorted(ids(q.where_node_type("user").join("RATED"))) == ["u1", "u2"]
    assert sorted(ids(q.join("RATED", "in"))) == ["b1", "b2", "b3"]
    if graph.nodes.schema["data"].dataType.typeName() == "struct":
        assert ids(q.join("RATED", predicate=F.col("data.genre") == "fantasy")) == ["u2"]


def test_a_dangling_neighbour_is_no_match(graph):
    alone = Graph(graph.nodes, graph.edges.where("target = 'gone'"))
    assert ids(alone.query().join("RATED")) == []


def test_traversal(graph):
    q = graph.query().where("name", "Alice")
    assert ids(q.traverse("FOLLOWS", 0)) == ["u1"]
    assert sorted(ids(q.traverse("FOLLOWS", 1).traverse("RATED", 1))) == ["b1", "b2", "b3", "u1", "u2"]
    assert sorted(ids(graph.query().where("title", "LotR").traverse("RATED", 1, "in"))) == ["b3", "u2"]
    with pytest.raises(S.ResourceLimit):
        q.traverse("FOLLOWS", 3).with_limits(max_traversal_depth=2).to_df()
    with pytest.raises(S.ResourceLimit):
        q.traverse("FOLLOWS", 1).with_limits(max_nodes_visited=1).to_df()


def test_order_page_similarity(graph):
    q = graph.query().where_node_type("book")
    assert ids(q.order_by("price", "desc").offset(1).limit(2)) == ["b2", "b4"]
    assert ids(q.order_by("title").limit(2)) == ["b1", "b2"]
    assert ids(q.order_by("price", "desc").similar_to([1.0, 0.0], 0.5)) == ["b1", "b2"]
    assert ids(q.similar_to([1.0, 0.0], -1, 3)) == ["b1", "b2", "b4"]
    assert ids(q.similar_to([1.0, 0.0], -1, 0)) == []
    assert ids(q.similar_to([1.0, 0.0], 0.9, 2, engine="hnsw")) == ["b1", "b2"]
    assert q.order_by("price").first()["id"] == "b5"
    assert q.limit(3).offset(4).count() == 1
    with pytest.raises(S.ResourceLimit):
        q.with_limits(max_results=2).to_df()
    with pytest.raises(Exception, match="dimension_mismatch"):
        ids(q.similar_to([1.0, 0.0, 0.0]))


def test_aggregates(graph):
    q = graph.query().where_node_type("book")
    one = q.aggregate("price", "sum").first()
    assert (one["value"], one["count"]) == (71.0, 5)
    none = q.aggregate("title", "avg").first()
    assert (none["value"], none["count"]) == (0.0, 0)
    groups = {r["key"]: (r["value"], r["count"]) for r in q.group_aggregate("price", "avg", "genre").collect()}
    assert groups == {"sci-fi": (13.5, 2), "fantasy": (17.0, 2), "romance": (10.0, 1)}
    assert {r["key"]: r["count"] for r in graph.query().group_aggregate("title", "count", "rating").collect()} == {"5": 3, "4": 2}
    assert [r["key"] for r in q.having(q.group_aggregate("price", "sum", "genre"), F.col("value") > 30).collect()] == ["fantasy"]
    near = {r["key"]: r["value"] for r in q.group_by_vector({"x": [1.0, 0.0], "y": [0.0, 1.0]}, "price", "sum", 0.5).collect()}
    assert near == {"x": 27.0, "y": 34.0}
    assert sorted(r["value"] for r in q.unique_keys("name").collect() if r["value"]) == ["Alice", "Bob"]
    assert {r["id"] for r in graph.query().where("name", "Alice").collect_neighbours("RATED").collect()} == {"b1", "b2"}
    assert q.pluck("genre", "absent").columns == ["id", "type", "genre", "absent"]


def test_plan_documents(graph):
    doc = {"nodeTypes": ["book"], "attributes": [{"field": "price", "operator": "range", "above": 11}, {"field": "price", "operator": "range", "below": 15}], "order": {"field": "price", "direction": "desc"}, "limit": 5}
    assert ids(GraphQuery.from_plan(graph, doc)) == ["b4", "b1"]
    assert P.to_json(P.from_json(doc)) == doc
    with pytest.raises(S.GraphError):
        P.from_json({"sql": 1})
    with pytest.raises(S.GraphError):
        graph.query().limit(-1)


def test_explain_and_metrics(graph):
    q = graph.query().where_node_type("book").where("genre", "sci-fi").order_by("price").limit(1)
    found = q.explain()
    assert found["indexes"] == ["genre"] and found["stages"] == ["type-scan", "attribute-filter", "order", "limit"] and "TakeOrderedAndProject" in found["plan"]
    seen = []
    q.on_metrics(seen.append).to_list()
    assert seen[0]["rows"] == 1


def test_walks(graph):
    edges = graph.nodes.sparkSession.createDataFrame([("a", "T", "b", 1), ("a", "T", "c", 2), ("b", "T", "d", 3), ("d", "T", "a", 4)], "source string, type string, target string, _seq bigint")
    assert traverse.walk("a", edges, "T", False) == ["a", "b", "d"]
    assert traverse.walk("c", edges, "T", True) == ["b", "d", "a", "c"]


def test_deep_traversal_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    edges = spark.createDataFrame([(a, "E", b) for a, b in pairs], "source string, type string, target string")
    found = {r["id"]: r["hop"] for r in traverse.reach(spark.createDataFrame([("n0",)], "id string"), edges, ["E"], 7).collect()}
    want, frontier = {"n0": 0}, ["n0"]
    for hop in range(1, 8):
        frontier = sorted({b for a, b in pairs if a in frontier and b not in want})
        want |= dict.fromkeys(frontier, hop)
    assert found == want
