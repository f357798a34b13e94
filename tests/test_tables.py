import pytest

import linkgauge as lg
from linkgauge import GraphError
from tests import brute


def as_dict(frame, key, value):
    return {row[key]: row[value] for row in frame.collect()}


def test_last_link_wins(spark):
    rows = [("a", "b", 2.0, 1), ("a", "b", 5.0, 3), ("a", "b", 9.0, 2), ("b", "a", -1.0, 4), ("c", "c", None, 5)]
    frame = spark.createDataFrame(rows, "src string, dst string, w double, seq int")
    graph = lg.graph_from_edges(frame, weight="w", order="seq")
    assert {(r["src"], r["dst"]): r["weight"] for r in graph.edges.collect()} == {
        ("a", "b"): 5.0, ("b", "a"): 1.0, ("c", "c"): 1.0,
    }
    for each in (graph, lg.stored(graph)):
        header = each.header.first()
        assert (header["num_node"], header["num_link"], header["total_node_weight"]) == (3, 5, 3.0)
    assert as_dict(lg.in_degree(graph.vertices, graph.edges), "id", "in_degree") == {"a": 1, "b": 1, "c": 1}


def test_copies_shrink_before_the_shuffle(spark):
    frame = spark.createDataFrame([("a", "b", 1.0, 1)], "src string, dst string, w double, seq long")
    plan = lg.graph_from_edges(frame, weight="w", order="seq").edges._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("Exchange") < physical.index("partial_max_by")
    assert "SortAggregate" not in physical


def test_number_ids(spark):
    frame = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "a long, b long")
    graph = lg.stored(lg.graph_from_edges(frame, "a", "b"))
    rank = as_dict(lg.pagerank(graph, max_iter=8), "id", "page_rank")
    expected = brute.power_rank([("1", "2", 1.0), ("2", "1", 1.0), ("3", "1", 1.0)], dict.fromkeys("123", 1.0), 3, 8)
    assert rank == pytest.approx({int(k): v for k, v in expected.items()}, abs=1e-12)


def test_unknown_endpoints(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "x")], "src string, dst string")
    graph = lg.graph_from_edges(links, vertices=spark.createDataFrame([("a",), ("b",)], "id string"))
    assert as_dict(lg.missing_endpoints(graph.vertices, graph.edges), "id", "ends") == {"x": 2, "y": 1}
    with pytest.raises(GraphError, match="unknown nodes"):
        lg.check_endpoints(graph)
    with pytest.raises(GraphError, match="unknown nodes"):
        lg.stored(graph)


def test_degrees(graph_of):
    graph = graph_of([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "b")])
    assert as_dict(lg.in_degree(graph.vertices, graph.edges), "id", "in_degree") == {"a": 0, "b": 2, "c": 1, "d": 2}
    assert as_dict(lg.out_degree(graph.vertices, graph.edges), "id", "out_degree") == {"a": 2, "b": 2, "c": 1, "d": 0}
    assert lg.average_degree(graph).first().asDict() == {"num_node": 4, "num_edge": 5, "average_degree": 1.25}


def test_average_degree_of_nothing(graph_of):
    assert lg.average_degree(graph_of([])).first().asDict() == {"num_node": 0, "num_edge": 0, "average_degree": None}


def test_shares_with_and_without_hubs(graph_of, monkeypatch):
    links = brute.random_links(30, 60, 1, hub=True)
    graph = graph_of(links)
    totals, counts = {}, {}
    for a, _, w in links:
        totals[a] = totals.get(a, 0.0) + w
        counts[a] = counts.get(a, 0) + 1
    for rows in (200_000, 10):
        monkeypatch.setattr("linkgauge.plans.loop.ROWS_PER_PARTITION", rows)
        by_weight = {(r["src"], r["dst"]): r["share"] for r in lg.out_weight_share(graph.edges).collect()}
        assert by_weight == pytest.approx({(a, b): w / totals[a] for a, b, w in links})
        by_count = {(r["src"], r["dst"]): r["share"] for r in lg.out_degree_share(graph.edges).collect()}
        assert by_count == pytest.approx({(a, b): 1 / counts[a] for a, b, _ in links})


def test_teleport_and_dangling(graph_of):
    graph = graph_of([("a", "b"), ("c", "b")], {"a": 3, "b": 0.5, "c": -2, "d": 4})
    total = as_dict(lg.teleport_weights(graph), "id", "teleport")
    assert total == pytest.approx({"a": 3 / 8.5, "b": 0.5 / 8.5, "c": 1 / 8.5, "d": 4 / 8.5})
    by_count = as_dict(lg.teleport_weights(graph, "count"), "id", "teleport")
    assert by_count == pytest.approx({"a": 0.75, "b": 0.125, "c": 0.25, "d": 1.0})
    assert {r["id"] for r in lg.dangling_nodes(graph.vertices, graph.edges).collect()} == {"b", "d"}
    rank = lg.teleport_weights(graph, "count").withColumnRenamed("teleport", "page_rank")
    assert lg.dangling_mass(graph.vertices, graph.edges, rank).first().asDict() == {
        "dangling_count": 2, "dangling_mass": 1.125,
    }
    with pytest.raises(ValueError):
        lg.teleport_weights(graph, "other")


ALGORITHMS = {
    "pagerank": lambda graph: lg.pagerank(graph, max_iter=2, min_iter=1),
    "pagerank_static": lambda graph: lg.pagerank_static(graph, 1),
    "pagerank_delta": lambda graph: lg.pagerank_delta(graph, 0.1),
    "betweenness": lg.betweenness,
    "shortest_paths": lambda graph: lg.shortest_paths(graph, all_sources=True),
    "stored": lg.stored,
}


@pytest.mark.parametrize("links", [[("x", "a"), ("a", "b")], [("a", "x"), ("a", "b")], [("a", None), ("a", "b")]])
@pytest.mark.parametrize("name", ALGORITHMS)
def test_unknown_ends_raise(spark, name, links):
    vertices = spark.createDataFrame([("a",), ("b",)], "id string")
    frame = spark.createDataFrame(links, "src string, dst string")
    graph = lg.graph_from_edges(frame, vertices=vertices)
    with pytest.raises(lg.GraphError, match="unknown"):
        ALGORITHMS[name](graph)


def test_duplicates_without_order_fold(spark):
    frame = spark.createDataFrame([("a", "b", 2.0), ("a", "b", 5.0), ("a", "c", 1.0)], "src string, dst string, w double")
    graph = lg.stored(lg.graph_from_edges(frame, weight="w"))
    assert sorted(map(tuple, graph.edges.collect())) == [("a", "b", 5.0), ("a", "c", 1.0)]
    assert graph.header.first()["link_lines"] == 3
    assert as_dict(lg.in_degree(graph.vertices, graph.edges), "id", "in_degree") == {"a": 0, "b": 1, "c": 1}


def test_sizes_of_loops():
    from linkgauge.plans.loop import BUILD_ROWS, MOST_PARTITIONS, partitions_for

    assert partitions_for(10**6) == 10
    assert partitions_for(10**12) == MOST_PARTITIONS
    assert partitions_for(10**12, most=10**7) == 10**7
    assert 10**10 <= BUILD_ROWS * partitions_for(10**10)
    assert 10**12 > BUILD_ROWS * partitions_for(10**12)


def test_large_builds_are_sorted(spark):
    from linkgauge.plans.loop import hashed

    frame = spark.range(10).withColumnRenamed("id", "k")
    other = spark.range(10).withColumnRenamed("id", "k").repartition("k")
    for rows, kind in ((10, "ShuffledHashJoin"), (10**12, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = other.join(hashed(frame, rows, 4), "k", "left")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert kind in plan
