import math

import pytest
from pyspark.sql import functions as F

import linkgauge as lg
from linkgauge.functions.exact import exact_sum, exact_total
from linkgauge.operators import pagerank as pagerank_module
from tests import brute, fixtures
from tests.test_tables import as_dict

NETWORKS = {
    "five": (fixtures.FIVE, fixtures.FIVE_RANK),
    "classic": (fixtures.CLASSIC, fixtures.CLASSIC_RANK),
    "families": (fixtures.FAMILIES, fixtures.FAMILIES_RANK),
}


def ranks(graph, **options):
    return as_dict(lg.pagerank(graph, **options), "id", "page_rank")


def arcs(text):
    lines = [line.split() for line in text.split("*Arcs")[1].splitlines()[1:]]
    return [(line[0], line[1], 1.0) for line in lines if line]


@pytest.mark.parametrize("name", list(NETWORKS))
def test_dense_form_gives_the_known_ranks(name):
    """What the short runs below are compared with is right in the long run."""
    text, expected = NETWORKS[name]
    ones = dict.fromkeys(expected, 1.0)
    assert brute.power_rank(arcs(text), ones, len(ones), 400) == pytest.approx(expected, abs=1e-9)
    scaled = {k: v * len(expected) for k, v in expected.items()}
    assert brute.open_rank(arcs(text), 400, 0.15) == pytest.approx(scaled, abs=1e-9)
    assert brute.delta_rank(arcs(text), 1e-12) == pytest.approx(scaled, abs=1e-9)


# Small graphs whose fixed point is easy to derive by hand.
BY_HAND = {
    "dangling node, node without in-links": (
        [("a", "b", 1.0)], {"a": 1.0, "b": 1.0}, "total_weight", {"a": 1 / 2.85, "b": 1.85 / 2.85},
    ),
    "link weights": (
        [("a", "b", 3.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], dict.fromkeys("abc", 1.0),
        "total_weight", {"a": 0.9 / 1.85, "b": 0.66625 / 1.85, "c": 0.28375 / 1.85},
    ),
    "node weights over their sum": (
        [("a", "b", 1.0), ("b", "a", 1.0)], {"a": 3.0, "b": 1.0}, "total_weight", {"a": 0.9625 / 1.85, "b": 0.8875 / 1.85},
    ),
    "node weights over the count": (
        [("a", "b", 1.0), ("b", "a", 1.0)], {"a": 3.0, "b": 1.0}, "count", {"a": 0.5375, "b": 0.4625},
    ),
}


@pytest.mark.parametrize("name", list(BY_HAND))
def test_by_hand(graph_of, name):
    links, weights, teleport, expected = BY_HAND[name]
    divisor = len(weights) if teleport == "count" else sum(weights.values())
    assert brute.power_rank(links, weights, divisor, 400) == pytest.approx(expected, abs=1e-9)
    found = ranks(graph_of(links, weights), teleport=teleport, max_iter=8)
    assert found == pytest.approx(brute.power_rank(links, weights, divisor, 8), abs=1e-12)


def test_unnormalised_forms(pajek):
    graph = pajek(fixtures.CLASSIC)
    static = lg.pagerank_static(graph, 10)
    assert as_dict(static.vertices, "id", "page_rank") == pytest.approx(
        brute.open_rank(arcs(fixtures.CLASSIC), 10, 0.15), abs=1e-12
    )
    delta = lg.pagerank_delta(graph, 0.01)
    assert as_dict(delta.vertices, "id", "page_rank") == pytest.approx(
        brute.delta_rank(arcs(fixtures.CLASSIC), 0.01), abs=1e-12
    )
    degree = as_dict(lg.out_degree(graph.vertices, graph.edges), "id", "out_degree")
    for ranked in (static, delta):
        shares = {(r["src"], r["dst"]): r["share"] for r in ranked.edges.collect()}
        assert shares == pytest.approx({(r["src"], r["dst"]): 1 / degree[r["src"]] for r in graph.edges.collect()})


def test_unnormalised_dangling(graph_of):
    graph = graph_of([("a", "b")])
    expected = {"a": 0.15, "b": 0.2775}
    assert as_dict(lg.pagerank_static(graph, 3).vertices, "id", "page_rank") == pytest.approx(expected)
    assert as_dict(lg.pagerank_delta(graph, 1e-9).vertices, "id", "page_rank") == pytest.approx(expected)


def test_duplicate_link_counts_for_normalised_rank(pajek):
    graph = pajek('*Vertices 2\n1 "a"\n2 "b"\n*Arcs 2\n1 2 2\n1 2 5\n')
    rank = lg.pagerank(graph, max_iter=4)
    plain = as_dict(rank, "id", "page_rank")
    scaled = as_dict(lg.normalized(rank, graph), "id", "page_rank_normalized")
    assert scaled == pytest.approx({k: 2 * v for k, v in plain.items()})


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_dense_with_hubs(graph_of, partitions):
    """Node and link weights, dangling nodes, self-loops; five partitions make hubs."""
    links = brute.random_links(40, 90, 7, hub=True)
    weights = {v: 1.0 + i % 5 for i, v in enumerate(brute.ids_of(links))} | {"alone": 2.0}
    graph = graph_of(links, weights)
    options = {"max_iter": 12, "min_iter": 12, "partitions": partitions}
    expected = brute.power_rank(links, weights, sum(weights.values()), 12)
    found = lg.pagerank(graph, **options)
    assert as_dict(found, "id", "page_rank") == pytest.approx(expected, abs=1e-12)
    assert sum(expected.values()) == pytest.approx(1.0)
    senders = {a for a, *_ in links}
    held = sum(r for v, r in expected.items() if v not in senders)
    flow = {v: (0.15 + 0.85 * held) * w / sum(weights.values()) for v, w in weights.items()}
    assert as_dict(found, "id", "teleport_flow") == pytest.approx(flow, abs=1e-9)
    by_count = brute.power_rank(links, weights, len(weights), 12)
    assert ranks(graph, teleport="count", **options) == pytest.approx(by_count, abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 4])
def test_static_against_dense(graph_of, partitions):
    links = brute.random_links(30, 80, 3, hub=True)
    graph = graph_of(links)
    for initial in (None, 1.0):
        found = lg.pagerank_static(graph, 9, initial_rank=initial, partitions=partitions).vertices
        expected = brute.open_rank(links, 9, 0.15 if initial is None else initial)
        assert as_dict(found, "id", "page_rank") == pytest.approx(expected, abs=1e-12)


def test_delta_drops_small_gains(graph_of):
    """A chain: each gain is 0.85 of the one before, and one at most tol is not sent on."""
    graph = graph_of([("a", "b"), ("b", "c"), ("c", "d")])
    found = as_dict(lg.pagerank_delta(graph, 0.12).vertices, "id", "page_rank")
    first, second = 0.15 * 0.85, 0.15 * 0.85**2
    assert second < 0.12 < first
    expected = {"a": 0.15, "b": 0.15 + first, "c": 0.15 + first + second, "d": 0.15 + first + second}
    assert found == pytest.approx(expected)
    assert as_dict(lg.pagerank_delta(graph, 0.15).vertices, "id", "page_rank") == dict.fromkeys("abcd", 0.15)


def test_two_rings(graph_of):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x")]
    found = ranks(graph_of(ring), max_iter=6)
    assert found == pytest.approx(dict.fromkeys("abcxy", 0.2))


def test_no_nodes(graph_of):
    graph = graph_of([])
    assert lg.pagerank(graph).isEmpty()
    assert lg.pagerank_static(graph, 3).vertices.isEmpty()
    assert lg.pagerank_delta(graph, 0.1).vertices.isEmpty()


def test_one_exchange_per_round(graph_of, spark):
    """Only the sums per target are shuffled: links and state stay where they are."""
    plans = []
    from linkgauge.operators import pagerank as module

    kept = module.checkpoint

    def spy(frame):
        plan = frame._jdf.queryExecution().toString()
        plans.append(plan[plan.index("== Physical Plan =="):])
        return kept(frame)

    module.checkpoint = spy
    try:
        lg.pagerank(graph_of(brute.random_links(20, 50, 5)), max_iter=3, min_iter=1, partitions=2)
    finally:
        module.checkpoint = kept
    # The second line of an exchange belongs to the cached links.
    last = plans[-1].split("InMemoryRelation")[0]
    assert last.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plans[-1] and "Sort " not in plans[-1]


def test_settings_come_back(graph_of, spark):
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    with pytest.raises(lg.GraphError):
        lg.pagerank(graph_of([("a", "x")], {"a": 1}))
    assert [spark.conf.get(k) for k in keys] == before


@pytest.mark.parametrize("form", ["power", "static", "delta"])
def test_same_bits_whatever_the_partitions(spark, form):
    """Weights without a common binary place, in other orders and other partitions."""
    links = [(a, b, w / 7 + 10.0 ** -(int(w) % 5)) for a, b, w in brute.random_links(60, 900, 3, hub=True)]
    runs = []
    for partitions, order in ((1, links), (3, links[::-1]), (8, links[450:] + links[:450])):
        nodes = [(v, 1 / (1 + i)) for i, v in enumerate(sorted({e for a, b, _ in order for e in (a, b)}))]
        graph = lg.graph_from_edges(
            spark.createDataFrame(order, "src string, dst string, weight double").repartition(partitions), weight="weight",
            vertices=spark.createDataFrame(nodes[::-1] if partitions > 1 else nodes, "id string, w double"), node_weight="w",
        )
        frame = {
            "power": lambda: lg.pagerank(graph, min_iter=20, max_iter=20, partitions=partitions),
            "static": lambda: lg.pagerank_static(graph, 10, partitions=partitions).vertices,
            "delta": lambda: lg.pagerank_delta(graph, 1e-3, partitions=partitions).vertices,
        }[form]()
        runs.append(sorted((r["id"], r["page_rank"].hex()) for r in frame.collect()))
    assert runs[0] == runs[1] == runs[2]


def test_exact_sums_of_far_apart_terms(spark):
    values = [1e16, 1.0, -1e16, 3e-9, 0.1, -0.1, 7.25] * 50
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    found = frame.agg(F.expr(f"{exact_sum('v', sum(map(abs, values)))} AS s")).first()["s"]
    assert found == pytest.approx(math.fsum(values), abs=1e-7)
    # another bound cuts terms off at another place
    assert exact_total(frame, "v").first()["total"] == pytest.approx(math.fsum(values), abs=1e-7)
    assert exact_total(frame.repartition(2), "v").first()["total"] == exact_total(frame, "v").first()["total"]
    assert exact_total(frame.where("v > 1e17"), "v").first()["total"] == 0.0


def test_delta_rounds_write_only_gains(graph_of, monkeypatch):
    """A long chain hangs on a ring: late rounds have few senders, and write few rows."""
    written = []
    real = pagerank_module._next_round

    def counted(state, passing=(), **scalars):
        frame, seen = real(state, passing, **scalars, rows_written="count(*)")
        written.append(seen["rows_written"])
        return frame, seen

    monkeypatch.setattr(pagerank_module, "_next_round", counted)
    links = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(40)]
    got = as_dict(lg.pagerank_delta(graph_of(links), 1e-9).vertices, "id", "page_rank")
    assert got == pytest.approx(brute.delta_rank(links, 1e-9), abs=1e-12)
    assert written[0] == 41 and written[1] == 40 and written[30] < 15


@pytest.mark.parametrize("inner", [[], [("s0", "s1", 2.0), ("s1", "s0", 1.0), ("s1", "s2", 1.0)]])
def test_outer_nodes_take_no_part_in_the_rounds(graph_of, monkeypatch, inner):
    """Nodes that nothing links to are not in the state of the rounds, nor their links in what is shuffled there."""
    links = [(f"c{i}", f"s{(i * j) % 3}", 1.0 + j) for i in range(6) for j in (1, 2)]
    links = list({(a, b): (a, b, w) for a, b, w in links + inner}.values())
    weights = {v: 1.0 + i % 4 for i, v in enumerate(brute.ids_of(links))} | {"alone": 3.0}
    seen, next_round = [], pagerank_module._next_round

    def counting(state, passing=(), **scalars):
        found = next_round(state, passing, **scalars)
        seen.append(found[0].count())
        return found

    monkeypatch.setattr(pagerank_module, "_next_round", counting)
    found = ranks(graph_of(links, weights), max_iter=4, min_iter=4, partitions=2)
    assert found == pytest.approx(brute.power_rank(links, weights, sum(weights.values()), 4), abs=1e-12)
    assert seen == [len(weights)] + 4 * [3]
