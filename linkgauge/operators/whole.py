"""Searches from many sources, each task with all links: for graphs whose links fit into a task.

A task gets its sources and the links, and searches a few sources at a time from the first level to the last and back, without a
job for each level. A cell is ``column * stride + position`` of a source and a node; ``stride`` is a power of two, so that either
is read off the cell's bits. A level is found along links out of the last one, or along links into the nodes that
are not found yet, whichever are fewer. The links on shortest paths are kept for the way back.

A node with one link reaches all else through the node that it leads to, and is on no shortest path from there but to nodes that it
leads to itself. So nodes with one link share the search of the first node on their way that has several, or none: its root. In
that search a node counts as often as there are sources that don't pass it on their way to the root; what is on that way is counted in
closed form.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks get these few functions along with their work, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links and nodes of a graph that a task takes whole at most.
MOST_LINKS, MOST_NODES = 8_000_000, 1_000_000
#: Links and nodes of a row that the graph is sent in, about.
ROW_LINKS, ROW_NODES = 1_000_000, 500_000
#: Sources that are worth a task, and tasks for each core.
LEAST_SOURCES, TASKS_PER_CORE = 8, 3
#: Links and nodes that a batch meets for each core, once for each source.
BATCH_WORK = 10_000_000_000
#: Cells searched at a time, and links of them; one source at least.
CELLS, CELL_LINKS = 1 << 19, 4_000_000
#: Links gathered at a time.
GATHERED = 1 << 17
#: Rows sent back at a time.
SENT = 1 << 16

FOUND = "place long, score double, square double, reach double, come double, touched long"


def fits(nodes: int, links: int) -> bool:
    return nodes <= MOST_NODES and links <= MOST_LINKS


def tasks_for(sources: int, cores: int) -> int:
    return max(1, min(TASKS_PER_CORE * cores, -(-sources // LEAST_SOURCES)))


def row_size(nodes: int, links: int) -> int:
    """Nodes of a row that the graph is sent in."""
    rows = max(1, -(-links // ROW_LINKS), -(-nodes // ROW_NODES))
    return max(1, -(-nodes // rows))


class Ends(NamedTuple):
    """Links by one end: those of node i are at ``first[i]``, ``number[i]`` of them, and lead to ``other``."""

    first: np.ndarray
    number: np.ndarray
    other: np.ndarray

    @staticmethod
    def of(here: np.ndarray, other: np.ndarray, nodes: int) -> Ends:
        """From links sorted by the end ``here``."""
        number = np.bincount(here, minlength=nodes)
        return Ends(np.cumsum(number) - number, number, other)

    def along(self, cells: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the cells, cell at the other end) for every link of the cells, some at a time."""
        node = cells & low
        number = self.number[node]
        ends = np.cumsum(number)
        shift, column = self.first[node] - ends + number, cells - node
        cuts = np.searchsorted(ends, np.arange(GATHERED, ends[-1] if len(ends) else 0, GATHERED), side="right")
        for a, b in zip([0, *cuts], [*cuts, len(cells)]):
            if a < b:
                here = np.repeat(np.arange(a, b), number[a:b])
                place = shift[here] + np.arange(ends[b - 1] - len(here), ends[b - 1])
                yield here, self.other[place] + column[here]


def search(out: Ends, into: Ends, sources: np.ndarray, weight: Callable, stride: int, scored: bool) -> tuple[np.ndarray, ...]:
    """Which nodes each source reaches, and columns, nodes and dependencies of those cells, the sources' own left out. ``weight`` gives
    the weights of columns and nodes as pairs; as in ``blocks``, with sigma paths to a node and delta its dependency, it gains
    ``sigma * sum((weight + delta) / sigma)`` over its successors on shortest paths."""
    width, nodes, low, bits = len(sources), len(out.number), stride - 1, (stride - 1).bit_length()
    found = np.full(width * stride, -1, np.int32)  # the how manieth a cell was found
    cells = sources + np.arange(width, dtype=np.int64) * stride
    found[cells] = np.arange(width)
    found.reshape(width, stride)[:, nodes:] = 0
    levels, paths, links, total = [cells], [np.ones(width)], [], width
    while True:
        above, below = [], []
        waiting, downward = None, out.number[cells & low].sum()
        if downward > len(found) // 8:
            waiting = np.flatnonzero(found < 0)
            if into.number[waiting & low].sum() >= downward:
                waiting = None
        if waiting is not None:
            for here, come_from in into.along(waiting, low):
                order = found[come_from]
                hit = np.flatnonzero(order >= total - len(cells))
                above.append(order[hit] - np.int32(total - len(cells)))
                below.append(here[hit])
            below = np.concatenate(below) if below else cells[:0]
            new = np.diff(below, prepend=-1) != 0
            cells, below = waiting[below[new]], np.cumsum(new, dtype=np.int32) - np.int32(1)
            found[cells] = np.arange(total, total + len(cells))
        else:
            for here, to in out.along(cells, low):
                hit = np.flatnonzero(found[to] < 0)
                above.append(here[hit].astype(np.int32))
                below.append(to[hit])
            to = np.concatenate(below) if below else cells[:0]
            order = np.arange(len(to), dtype=np.int32)
            found[to] = order
            cells = to[found[to] == order]
            found[cells] = np.arange(total, total + len(cells))
            below = found[to] - np.int32(total)
        if not len(cells):
            break
        total += len(cells)
        levels.append(cells)
        if scored:
            above = np.concatenate(above)
            links.append((above, below))
            paths.append(np.bincount(below, paths[-1][above], len(cells)))
    there, deltas, gained = found.reshape(width, stride)[:, :nodes] >= 0, [], np.zeros(len(levels[-1]))
    if not scored or len(levels) == 1:
        return there, cells, cells, gained[:0]
    for depth in range(len(levels) - 1, 0, -1):
        delta = paths[depth] * gained
        deltas.append(delta)
        if depth > 1:
            (above, below), cells = links[depth - 1], levels[depth]
            gained = np.bincount(above, ((weight(cells >> bits, cells & low) + delta) / paths[depth])[below], len(levels[depth - 1]))
    cells = np.concatenate(levels[:0:-1])
    return there, cells >> bits, cells & low, np.concatenate(deltas)


def roots(out: Ends) -> np.ndarray:
    """The node whose search each node shares; its own if its way ends in a ring of nodes with one link."""
    nodes = len(out.number)
    one = out.number == 1
    to = np.arange(nodes)
    to[one] = out.other[out.first[one]]
    for _ in range(nodes.bit_length()):
        to = to[to]
    return np.where(one[to], np.arange(nodes), to)


class Ways(NamedTuple):
    """From every node that shares a search the way to its root, ``nodes`` where it ends. Sums leave the root out."""

    step: np.ndarray
    hung: np.ndarray

    @staticmethod
    def of(out: Ends, root: np.ndarray) -> Ways:
        nodes = len(root)
        hung = root != np.arange(nodes)
        step = np.full(nodes + 1, nodes)
        at = np.flatnonzero(hung)
        to = out.other[out.first[at]]
        step[at[hung[to]]] = to[hung[to]]
        return Ways(step, hung)

    def along(self, values: np.ndarray) -> np.ndarray:
        """Sums over a node's way, itself included."""
        total, step = np.append(np.where(self.hung, values, 0.0), 0.0), self.step
        while (step < len(values)).any():
            total, step = total + total[step], step[step]
        return total[:-1]

    def behind(self, values: np.ndarray) -> np.ndarray:
        """Sums over the nodes whose way a node is on, itself included."""
        total, step, nodes = np.where(self.hung, values, 0.0), self.step, len(values)
        while (step < nodes).any():
            total, step = total + np.bincount(step[:-1], total, nodes + 1)[:-1], step[step]
        return total


def summed(out: Ends, into: Ends, s: np.ndarray, t: np.ndarray, scored: bool, shared: bool) -> np.ndarray:
    """score, square, reach, come, touched of all nodes. A node stands for ``s`` sources and ``t`` targets. Squares are of use only
    if no search is shared."""
    nodes = len(s)
    root = roots(out) if shared else np.arange(nodes)
    ways = Ways.of(out, root)
    hung = np.flatnonzero(ways.hung)
    every, behind = np.bincount(root, s, nodes), ways.behind(s)
    score, square, reach, come, touched = result = np.zeros((5, nodes))
    inside, column = np.zeros(nodes), np.full(nodes, -1)
    stride = 1 << (nodes - 1).bit_length()
    width = max(1, min(CELLS // stride, CELL_LINKS // max(1, len(out.other))))
    searches = np.flatnonzero(every)
    for at in range(0, len(searches), width):
        own = searches[at : at + width]

        def weight(column: np.ndarray, node: np.ndarray) -> np.ndarray:
            weights = every[own][column]
            return t[node] * (weights - np.where(root[node] == own[column], behind[node], 0.0) if len(hung) else weights)

        there, columns, node, delta = search(out, into, own, weight, stride, scored)
        score += np.bincount(node, delta, nodes)
        square += np.bincount(node, delta * delta / every[own][columns], nodes)
        come += every[own] @ there
        reach[own], touched[own] = there @ t, there.sum(axis=1)
        if len(hung):
            column[own] = np.arange(len(own))
            of = column[root[hung]]
            inside[hung[of >= 0]] = there[of[of >= 0], hung[of >= 0]]
            column[own] = -1
    if len(hung):
        beyond = reach[root]
        score += np.where(ways.hung, 0.0, (every - s) * (reach - t)) - np.bincount(root, inside * t * behind, nodes)
        within = ways.along(inside * t)
        way = ways.along(t)
        score += np.where(ways.hung, (behind - s) * (beyond + way - t) - ways.behind(s * within) + s * within, 0.0)
        come += np.where(inside > 0, 0.0, behind)
        reach += np.where(ways.hung, beyond + way - within, 0.0)
    reach[s == 0] = 0.0
    if not scored:
        score[:] = 0.0
    return result


def _graph(rows: list[tuple[bytes, bytes]], nodes: int) -> tuple[Ends, Ends]:
    """Links out of and into the nodes."""
    come_from, to = (np.concatenate([np.frombuffer(r[i], np.int32) for r in rows]) for i in (0, 1))
    order = np.argsort(to, kind="stable")
    return Ends.of(come_from, to, nodes), Ends.of(to[order], come_from[order], nodes)


def rooted(nodes: int) -> Callable[[Iterator], Iterator]:
    """Rows part, come_from, to of the whole graph: place and root of all nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {p: ends for batch in batches for p, *ends in zip(*(c.to_pylist() for c in batch.columns))}
        if parts:
            root = roots(_graph([parts[p] for p in sorted(parts)], nodes)[0])
            for at in range(0, nodes, SENT):
                of = root[at : at + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(of))), pa.array(of)], ["place", "root"])

    return work


def searched(nodes: int, scored: bool, shared: bool) -> Callable[[Iterator], Iterator]:
    """Rows g, place, s, part, t, come_from, to: sources of a task, and with each of them the whole graph by parts. All sources that
    share a search are in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, parts = {}, {}
        for batch in batches:
            for g, place, weight, part, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                given[g], parts[part] = (place, weight), arrays
        if not given:
            return
        s = np.zeros(nodes)
        for place, weight in given.values():
            s[np.frombuffer(place, np.int32)] = np.frombuffer(weight)
        rows = [parts[p] for p in sorted(parts)]
        t = np.concatenate([np.frombuffer(r[0]) for r in rows])
        out, into = _graph([r[1:] for r in rows], nodes)
        parts = rows = None
        found = summed(out, into, s, t, scored, shared)
        places = np.flatnonzero(found.any(axis=0))
        for at in range(0, len(places), SENT):
            p = places[at : at + SENT]
            *values, touched = found[:, p]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), *(pa.array(v) for v in values), pa.array(touched.astype(np.int64))],
                ["place", "score", "square", "reach", "come", "touched"],
            )

    return work


def all_roots(graph: DataFrame, nodes: int) -> DataFrame:
    """place, root of all nodes of ``graph`` (part, t, come_from, to)."""
    return graph.select("part", "come_from", "to").coalesce(1).mapInArrow(rooted(nodes), "place long, root long")


def meet(given: DataFrame, graph: DataFrame, tasks: int, nodes: int, scored: bool, shared: bool) -> DataFrame:
    """Run the searches of ``given`` (g, place, s), a task for each g, on ``graph`` (part, t, come_from, to). A task reads the graph's files
    itself, so it goes neither through a shuffle nor through the driver."""
    dealt = given.repartitionById(tasks, F.col("g"))
    met = dealt.crossJoin(graph.coalesce(1).hint("shuffle_replicate_nl"))
    found = met.select("g", "place", "s", "part", "t", "come_from", "to").mapInArrow(searched(nodes, scored, shared), FOUND)
    return found.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("score", "square", "reach", "come", "touched")])
