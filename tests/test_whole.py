"""Searches whose tasks take all links."""

import numpy as np
import pytest

from linkgauge.operators import paths, whole
from linkgauge.plans.ledger import Ledger
from tests import brute
from tests.test_paths import scores
from tests.test_resume import Lost, after, job


def pairs(nodes, links, s, t):
    """score, reach, come by every pair of a source and a target."""
    dist, count = np.full((nodes, nodes), -1), np.zeros((nodes, nodes))
    for x in range(nodes):
        level, dist[x, x], count[x, x] = [x], 0, 1.0
        while level:
            following = []
            for a, b in ((a, b) for a in level for c, b in links if a == c):
                if dist[x, b] < 0:
                    following.append(b)
                    dist[x, b] = dist[x, a] + 1
                if dist[x, b] == dist[x, a] + 1:
                    count[x, b] += count[x, a]
            level = following
    score = np.zeros(nodes)
    for x, y, v in np.ndindex(nodes, nodes, nodes):
        if len({x, y, v}) == 3 and min(dist[x, y], dist[x, v], dist[v, y]) >= 0 and dist[x, v] + dist[v, y] == dist[x, y]:
            score[v] += s[x] * t[y] * count[x, v] * count[v, y] / count[x, y]
    there = dist >= 0
    return score, np.where(s > 0, there @ t, 0.0), s @ there


def ends(links, nodes):
    come_from, to = (np.array([p[i] for p in links], np.int32) for i in (0, 1))
    return whole._graph([(come_from.tobytes(), to.tobytes())], nodes)


@pytest.mark.parametrize("gathered, cells", [(3, 1 << 19), (1 << 17, 1), (1 << 17, 40)])
@pytest.mark.parametrize("shared", [True, False])
def test_sums_are_those_of_all_pairs(monkeypatch, gathered, cells, shared):
    monkeypatch.setattr(whole, "GATHERED", gathered)
    monkeypatch.setattr(whole, "CELLS", cells)
    hung = 0
    for seed in range(40):
        draw = np.random.default_rng(seed)
        nodes = int(draw.integers(1, 12))
        links = sorted({(int(a), int(b)) for a, b in draw.integers(0, nodes, (int(draw.integers(0, 2 * nodes + 1)), 2)) if a != b})
        s, t = draw.integers(0, 4, nodes).astype(float), draw.integers(1, 5, nodes).astype(float)
        out, into = ends(links, nodes)
        hung += (whole.roots(out) != np.arange(nodes)).sum()
        found, expected = whole.summed(out, into, s, t, True, shared), pairs(nodes, links, s, t)
        for i, values in zip((0, 2, 3), expected):
            assert found[i] == pytest.approx(values, abs=1e-9)
        alone = whole.summed(out, into, s, t, False, shared)
        assert alone[2:4].tolist() == found[2:4].tolist() and not alone[0].any()
    assert hung > 40


def test_dense_levels_are_found_from_the_nodes_that_wait(monkeypatch):
    draw, nodes = np.random.default_rng(3), 60
    links = sorted({(int(a), int(b)) for a, b in draw.integers(0, nodes, (900, 2)) if a != b})
    out, into = ends(links, nodes)
    calls, along = [], whole.Ends.along
    monkeypatch.setattr(whole.Ends, "along", lambda self, *given: calls.append(self is into) or along(self, *given))
    one = np.ones(nodes)
    found = whole.summed(out, into, one, one, True, True)
    assert any(calls) and not all(calls)
    assert found[0] == pytest.approx(pairs(nodes, links, one, one)[0], abs=1e-9)


def test_rings_and_ways_to_a_root():
    links = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 5), (5, 6), (6, 7), (6, 8), (8, 4)]
    assert whole.roots(ends(links, 9)[0]).tolist() == [0, 1, 2, 3, 6, 6, 6, 7, 6]


def test_levels_take_no_jobs_of_their_own(graph_of, monkeypatch):
    """A ring of 40 levels is searched in one job for each batch, from the first level to the last and back."""
    monkeypatch.setattr(paths._Batch, "_written", lambda *given: pytest.fail("a level was written"))
    batches, meet = [], whole.meet
    monkeypatch.setattr(whole, "meet", lambda *given: batches.append(given) or meet(*given))
    links = [(f"a{i:02}", f"a{(i + 1) % 40:02}") for i in range(40)] + [("a00", "a05"), ("a20", "a21"), ("a20", "a30")]
    assert scores(graph_of(links)) == pytest.approx(brute.betweenness(links), abs=1e-9)
    assert len(batches) == 1


def test_a_job_keeps_to_the_way_it_was_begun_in(graph_of, spark, monkeypatch):
    """Sources go to batches in another way in blocks."""
    links = brute.random_links(24, 40, 11)
    graph, tables = graph_of(links), brute.betweenness(links)
    for first, second in (({"partitions": 2}, {}), ({}, {"partitions": 2})):
        name = job()
        with monkeypatch.context() as lost:
            after(1, lost)
            with pytest.raises(Lost):
                scores(graph, job=name, batch_rows=200, **first)
        assert Ledger(spark, name).entries()["batch-whole"]["value"] == (not first)
        assert scores(graph, job=name, batch_rows=200, **second) == pytest.approx(tables, abs=1e-9)


def test_graphs_that_do_not_fit_are_searched_in_blocks(graph_of, monkeypatch):
    monkeypatch.setattr(whole, "MOST_LINKS", 5)
    batches, close = [], paths._Batch.close
    monkeypatch.setattr(paths._Batch, "close", lambda self: batches.append(type(self)) or close(self))
    links = brute.random_links(24, 40, 11)
    assert scores(graph_of(links)) == pytest.approx(brute.betweenness(links), abs=1e-9)
    assert set(batches) == {paths._Batch}
