"""Dense, single-machine checks straight from the definitions."""

from __future__ import annotations

import numpy as np


def random_links(nodes: int, links: int, seed: int, hub: bool = False) -> list[tuple[str, str, float]]:
    """Distinct random links with weights; with ``hub`` node 0 sends and receives many."""
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, nodes, (links, 2))}
    if hub:
        pairs |= {(0, i) for i in range(1, nodes)} | {(i, 0) for i in range(1, nodes, 2)}
    return [(f"v{a}", f"v{b}", float(rng.integers(1, 9))) for a, b in sorted(pairs)]


def hanging_links(nodes: int, core: int, seed: int) -> list[tuple[str, str]]:
    """A random core with trees on it, whose links go up, down or both ways, and a tree of its own."""
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(0, core, (3 * core, 2))}
    for v in range(core, nodes):
        parent = int(rng.integers(0, v)) if v > core else 0
        way = rng.integers(0, 4)
        links |= ({(v, parent)} if way != 1 else set()) | ({(parent, v)} if way != 2 else set())
    links |= {(nodes, nodes + 1), (nodes + 1, nodes), (nodes + 1, nodes + 2), (nodes + 3, nodes + 1)}
    return [(f"v{a}", f"v{b}") for a, b in sorted(links)]


def ids_of(links) -> list[str]:
    return sorted({end for a, b, *_ in links for end in (a, b)})


def power_rank(links, weights: dict[str, float], divisor: float, rounds: int, alpha: float = 0.15) -> dict[str, float]:
    ids = sorted(weights)
    at = {v: i for i, v in enumerate(ids)}
    flow = np.zeros((len(ids), len(ids)))
    for a, b, w in links:
        flow[at[b], at[a]] += w
    sums = flow.sum(axis=0)
    dangling = sums == 0
    flow[:, ~dangling] /= sums[~dangling]
    teleport = np.array([weights[v] for v in ids]) / divisor
    rank = np.full(len(ids), 1.0 / len(ids))
    for _ in range(rounds):
        rank = (alpha + (1 - alpha) * rank[dangling].sum()) * teleport + (1 - alpha) * flow @ rank
        rank /= rank.sum()
    return dict(zip(ids, rank))


def open_rank(links, rounds: int, initial: float, alpha: float = 0.15) -> dict[str, float]:
    ids = ids_of(links)
    at = {v: i for i, v in enumerate(ids)}
    flow = np.zeros((len(ids), len(ids)))
    for a, b, *_ in links:
        flow[at[b], at[a]] += 1.0
    sums = flow.sum(axis=0)
    flow[:, sums > 0] /= sums[sums > 0]
    rank = np.full(len(ids), initial)
    for _ in range(rounds):
        rank = alpha + (1 - alpha) * flow @ rank
    return dict(zip(ids, rank))


def delta_rank(links, tol: float, alpha: float = 0.15) -> dict[str, float]:
    """Gains above ``tol`` are passed on once; the others stay where they are."""
    ids = ids_of(links)
    at = {v: i for i, v in enumerate(ids)}
    flow = np.zeros((len(ids), len(ids)))
    for a, b, *_ in links:
        flow[at[b], at[a]] += 1.0
    sums = flow.sum(axis=0)
    flow[:, sums > 0] /= sums[sums > 0]
    rank = gain = np.full(len(ids), alpha)
    while (gain[sums > 0] > tol).any():
        gain = (1 - alpha) * flow @ np.where(gain > tol, gain, 0.0)
        rank = rank + gain
    return dict(zip(ids, rank))


def distances_and_counts(links, ids) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of shortest paths from powers of the adjacency matrix."""
    at = {v: i for i, v in enumerate(ids)}
    step = np.zeros((len(ids), len(ids)))
    for a, b, *_ in links:
        if a != b:
            step[at[a], at[b]] = 1.0
    dist = np.where(np.eye(len(ids)) > 0, 0.0, np.inf)
    count = np.eye(len(ids))
    walks = np.eye(len(ids))
    for length in range(1, len(ids)):
        walks = walks @ step
        new = (walks > 0) & np.isinf(dist)
        dist[new] = length
        count[new] = walks[new]
    return dist, count


def betweenness(links, ids=None, sources=None) -> dict[str, float]:
    """Over pairs (s, t): the share of shortest paths through v, pair by pair."""
    ids = ids or ids_of(links)
    dist, count = distances_and_counts(links, ids)
    score = np.zeros(len(ids))
    for s in range(len(ids)):
        for t in range(len(ids)):
            if s == t or np.isinf(dist[s, t]) or (sources is not None and ids[s] not in sources):
                continue
            for v in range(len(ids)):
                if v not in (s, t) and dist[s, v] + dist[v, t] == dist[s, t]:
                    score[v] += count[s, v] * count[v, t] / count[s, t]
    return dict(zip(ids, score))
