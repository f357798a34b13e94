import numpy as np
import pytest

import linkgauge as lg
from linkgauge.operators import folding
from linkgauge.operators import paths as module
from linkgauge.plans import ledger
from tests import brute, fixtures
from tests.test_tables import as_dict


def scores(graph, **options):
    return as_dict(lg.betweenness(graph, **options), "id", "betweenness")


@pytest.mark.parametrize(
    "text, expected, total",
    [
        (fixtures.FIVE, fixtures.FIVE_BETWEENNESS, 12),
        (fixtures.CLASSIC, fixtures.CLASSIC_BETWEENNESS, 644),
        (fixtures.FAMILIES, fixtures.FAMILIES_BETWEENNESS, 312),
    ],
)
def test_known_networks(pajek, text, expected, total):
    graph = pajek(text)
    found = scores(graph)
    assert found == pytest.approx(expected, abs=1e-9)
    assert sum(found.values()) == pytest.approx(total)
    between = lg.shortest_paths(graph, all_sources=True).where("dist > 0").selectExpr("sum(dist - 1) AS s").first()["s"]
    assert between == total


def test_path_counting_and_self_loop(graph_of):
    graph = graph_of([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "b")])
    assert scores(graph) == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 0.0}
    rows = {(r["source"], r["id"]): (r["dist"], r["sigma"]) for r in lg.shortest_paths(graph, all_sources=True).collect()}
    assert rows[("a", "d")] == (2, 2.0) and rows[("b", "b")] == (0, 1.0)
    assert ("d", "a") not in rows
    assert lg.touched_nodes(graph) == len(rows) == 9


@pytest.mark.parametrize("options", [{}, {"partitions": 6}, {"partitions": 3, "batch_rows": 200}])
def test_against_pairs(graph_of, options):
    """Hubs on both ends are salted with several partitions; few rows make batches."""
    links = brute.random_links(24, 40, 11, hub=True)
    graph = graph_of(links)
    assert scores(graph, **options) == pytest.approx(brute.betweenness(links), abs=1e-9)
    ids = brute.ids_of(links)
    dist, count = brute.distances_and_counts(links, ids)
    rows = {(r["source"], r["id"]): (r["dist"], r["sigma"]) for r in lg.shortest_paths(graph, all_sources=True, **options).collect()}
    expected = {
        (ids[s], ids[t]): (dist[s, t], count[s, t])
        for s in range(len(ids)) for t in range(len(ids)) if not np.isinf(dist[s, t])
    }
    assert rows == expected


def test_long_path_rewrites_visited(graph_of, monkeypatch):
    monkeypatch.setattr(module, "LEVELS_PER_TABLE", 3)
    links = [(f"{i:02}", f"{i + 1:02}") for i in range(9)] + [("09", "05"), ("04", "01")]
    assert scores(graph_of(links)) == pytest.approx(brute.betweenness(links))


def test_some_sources(graph_of, spark):
    graph = graph_of([("a", "b"), ("b", "c"), ("c", "a")])
    only = spark.createDataFrame([("a",)], "id string")
    assert scores(graph, sources=only) == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_paths_of_some_sources(graph_of, spark):
    graph = graph_of([("a", "b"), ("b", "c"), ("c", "a")])
    with pytest.raises(ValueError, match="sources"):
        lg.shortest_paths(graph)
    only = spark.createDataFrame([("b",)], "id string")
    rows = lg.shortest_paths(graph, only).collect()
    assert sorted(map(tuple, rows)) == [("b", "a", 2, 1.0), ("b", "b", 0, 1.0), ("b", "c", 1, 1.0)]


def test_batches_never_outnumber_sources():
    assert module.batches_for(1, 8, 2) == 1
    assert module.batches_for(10, 10**9, 200_000_000) == 10
    assert module.batches_for(10**10, 10**10, 10**12) == 10**8
    assert module.batches_for(0, 5, 1) == 1


def test_batches_add_to_one_ledger(graph_of, monkeypatch):
    """However many batches there are, their rows go to one job's folder, each batch's to a table of its own."""
    tables = set()
    write = ledger.append
    monkeypatch.setattr(ledger, "append", lambda frame, path: (tables.add(path), write(frame, path)))
    links = brute.random_links(24, 40, 11, hub=True)
    assert scores(graph_of(links), partitions=2, batch_rows=200) == pytest.approx(brute.betweenness(links), abs=1e-9)
    assert len(tables) > 1 and len({path.rsplit("/", 1)[0] for path in tables}) == 1


def test_unreachable_parts_and_no_nodes(graph_of):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x")]
    assert scores(graph_of(ring)) == {"a": 1.0, "b": 1.0, "c": 1.0, "x": 0.0, "y": 0.0}
    assert lg.betweenness(graph_of([])).isEmpty()


@pytest.mark.parametrize("seed, options", [(2, {"partitions": 3}), (4, {})])
def test_what_hangs_is_counted_in_closed_form(graph_of, spark, monkeypatch, seed, options):
    links = brute.hanging_links(30, 6, seed)
    if seed == 4:
        monkeypatch.setattr(folding, "ROUNDS", 1)  # the rest of the trees is searched
    assert scores(graph_of(links), **options) == pytest.approx(brute.betweenness(links), abs=1e-9)
    chosen = [f"v{i}" for i in range(0, 34, 3)]
    some = spark.createDataFrame([(v,) for v in chosen], "id string")
    found = scores(graph_of(links), sources=some, **options)
    assert found == pytest.approx(brute.betweenness(links, sources=set(chosen)), abs=1e-9)


def test_trees_leave_no_links_to_search(spark):
    pairs = [(i, (i - 1) // 3) for i in range(1, 40)]
    links = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    nodes = spark.createDataFrame([(i, 1.0) for i in range(40)], "key long, own double")
    folded = folding.fold(nodes, links)
    assert folded.links.isEmpty() and folded.nodes == 1 and 2 < len(folded.rounds) < 6
    core = folded.core.first()
    assert (core["s"], core["t"]) == (40.0, 40.0)


def test_searches_run_in_blocks_of_nodes_and_groups_of_sources(graph_of, monkeypatch):
    """A level is one row for each group and block, however many pairs it holds."""
    monkeypatch.setattr(module.blocks, "LEAST_WIDTH", 5)
    monkeypatch.setattr(module.blocks, "LEAST_LINKS", 10)
    rows, written = [], module._Batch._written

    def counting(self, *given):
        found = written(self, *given)
        rows.append((found.count(), -(-24 // self.graph.width) * self.graph.count))
        return found

    monkeypatch.setattr(module._Batch, "_written", counting)
    links = brute.random_links(24, 40, 11, hub=True)
    assert scores(graph_of(links), partitions=3) == pytest.approx(brute.betweenness(links), abs=1e-9)
    assert all(found <= most for found, most in rows) and max(most for _, most in rows) > 3


def test_what_a_forest_reaches_needs_no_pairs(graph_of, monkeypatch):
    touched, close = [], module._Batch.close
    monkeypatch.setattr(module._Batch, "close", lambda self: touched.append(self.touched) or close(self))
    upward = [(f"v{i}", f"v{(i - 1) // 3}") for i in range(1, 20)]
    assert lg.touched_nodes(graph_of([*upward, *[(b, a) for a, b in upward]])) == 400
    assert touched == [1]
