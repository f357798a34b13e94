import numpy as np
import pytest

import linkgauge as lg
from linkgauge.operators import pivots as module
from tests import brute


def grown_links(nodes, seed):
    """Links to nodes that have many already, and some anywhere."""
    rng, ends, links = np.random.default_rng(seed), [0, 1], {(0, 1)}
    for v in range(2, nodes):
        for u in {ends[i] for i in rng.integers(0, len(ends), 2)} | set(rng.integers(0, v, 1).tolist()):
            links |= {(v, u)} | ({(u, v)} if rng.random() < 0.7 else set())
            ends += [u, v]
    return [(f"v{a}", f"v{b}") for a, b in sorted(links)]


def test_estimate_finds_the_top_and_keeps_its_bound(graph_of):
    graph = graph_of(grown_links(600, 5))
    exact = {r["id"]: r["betweenness"] for r in lg.betweenness(graph).collect()}
    rows = {r["id"]: r for r in lg.betweenness_estimate(graph, pivots=300).collect()}
    assert rows.keys() == exact.keys() and {r["pivots"] for r in rows.values()} == {300}
    assert all(abs(rows[v]["betweenness"] - exact[v]) <= rows[v]["error"] for v in exact)
    assert any(abs(rows[v]["betweenness"] - exact[v]) > 0 for v in exact)

    def top(values):
        return set(sorted(values, key=lambda v: (-values[v], v))[:50])

    recall = len(top(exact) & top({v: r["betweenness"] for v, r in rows.items()})) / 50
    assert recall >= 0.9


def test_stops_once_the_error_is_small_enough(graph_of):
    links = grown_links(400, 6)
    rows = lg.betweenness_estimate(graph_of(links), error=0.6).collect()
    taken = rows[0]["pivots"]
    assert taken in (64, 128, 256)
    assert max(r["error"] for r in rows) <= 0.6 * 400 * 398


@pytest.mark.parametrize("options", [{}, {"partitions": 3, "batch_rows": 200}])
def test_all_pivots_are_exact(graph_of, options):
    links = brute.random_links(24, 40, 11, hub=True)
    rows = lg.betweenness_estimate(graph_of(links), **options).collect()
    assert {r["id"]: r["betweenness"] for r in rows} == pytest.approx(brute.betweenness(links), abs=1e-9)
    assert {(r["error"], r["pivots"]) for r in rows} == {(0.0, len(rows))}


def test_small_graphs(graph_of):
    assert lg.betweenness_estimate(graph_of([])).isEmpty()
    for links in ([("a", "a")], [("a", "b")]):
        assert {(r["betweenness"], r["error"]) for r in lg.betweenness_estimate(graph_of(links)).collect()} == {(0.0, 0.0)}


def test_bounds_hold_on_drawn_samples():
    """Means of samples without replacement, of values of which few are large."""
    rng, missed = np.random.default_rng(1), 0
    values = np.where(rng.random(2000) < 0.03, rng.random(2000), 0.01 * rng.random(2000))
    for size in (64, 512, 1500, 1999):
        by_spread, added = module.error_terms(len(values), 1, size, 0.05)
        for _ in range(200):
            drawn = rng.choice(values, size, replace=False)
            missed += abs(drawn.mean() - values.mean()) > by_spread * drawn.std() + added
    assert missed == 0
    assert module.error_terms(2000, 1, 2000, 0.05) == (0.0, 0.0)


def test_rounds_double_up_to_all_nodes():
    assert module.pivot_rounds(300) == [64, 128, 256, 300]
    assert module.pivot_rounds(64) == [64] and module.pivot_rounds(5) == [5]
    assert module.pivot_rounds(300, 100) == [100] and module.pivot_rounds(50, 100) == [50]


def test_pivots_do_not_depend_on_the_layout(graph_of):
    links = grown_links(80, 7)
    found = [
        {r["id"]: r["betweenness"] for r in lg.betweenness_estimate(graph_of(links), pivots=20, seed=3, **o).collect()}
        for o in ({}, {"partitions": 5, "batch_rows": 400})
    ]
    assert found[0] == pytest.approx(found[1])
