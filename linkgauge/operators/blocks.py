"""Searches from many sources at once: nodes in blocks, sources in groups, a level of a group and a block in one row.

A row holds cells, numbers ``position * width + column`` of a node's position in its block and a source's column in
its group, and a value for each. Cells are a list or a bit for each possible one, whichever is shorter; numbers of paths are stored
in as few bytes as hold them. A level meets the links between two blocks in the task of the group and the block they lead to;
no task sees more than one block of nodes on either side at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks get these few functions along with their work, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of a group in a block, nodes of a block and links that lead from a block at most.
MOST_CELLS, MOST_NODES, MOST_LINKS = 2_000_000, 65_536, 4_000_000
#: Sources of a group, and links of a block, that are worth a task.
LEAST_WIDTH, LEAST_LINKS = 32, 500_000
#: Numbers gathered along links at a time.
GATHERED = 1 << 20
#: Numbers sent one by one cost so many times what they cost gathered along all links of a node at once.
SINGLY = 4

LEVEL = "g int, b int, cells binary, sigma binary, visited binary, n long, reach binary, come binary"
BACK = "g int, b int, cells binary, quotient binary, score binary, square binary"
MET = ["g", "b", "part", "kind", "x", "y", "z", "t", "s"]
#: Kinds of rows that meet in a task, in this order for each ``part``.
OWN, LINKS, ARRIVING = 0, 1, 2


def shape(nodes: int, links: int, sources: int, cores: int, blocks: int | None = None) -> tuple[int, int, int]:
    """(blocks, nodes of a block, sources of a group)."""
    least = max(1, -(-links // MOST_LINKS), -(-nodes // MOST_NODES))
    width = max(LEAST_WIDTH, -(-sources // (3 * cores)))
    if blocks is None:
        spread = -(-cores // max(1, -(-sources // width)))
        blocks = max(least, min(spread, -(-links // LEAST_LINKS)))
    size = max(1, -(-nodes // max(least, min(blocks, nodes))))
    return max(1, -(-nodes // size)), size, max(1, min(width, MOST_CELLS // size, sources))


def packed(rows: DataFrame, keys: list[str], order: str, **arrays: str) -> DataFrame:
    """One row for each of ``keys`` with columns of their rows as binary arrays of a numpy type, in one order."""
    names = list(arrays)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            joined = [np.concatenate([p[i] for p in parts]).astype(arrays[n]).tobytes() for i, n in enumerate(names)]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k], pa.int32()) for k in now), *(pa.array([j], pa.binary()) for j in joined)], [*keys, *names]
            )

        for batch in frames:
            ids = np.stack([batch.column(i).to_numpy() for i in range(len(keys))], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            values = [batch.column(len(keys) + i).to_numpy() for i in range(len(names))]
            for at, end in zip([0, *cuts], [*cuts, len(ids)]):
                if end > at:
                    if now is not None and tuple(ids[at]) != now:
                        yield out()
                        parts = []
                    now = tuple(ids[at])
                    parts.append([v[at:end] for v in values])
        if parts:
            yield out()

    columns = [*(f"cast({k} AS int) AS {k}" for k in keys), *names]
    wanted = ", ".join([*(f"{k} int" for k in keys), *(f"{n} binary" for n in names)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).selectExpr(*columns).mapInArrow(work, wanted)


def cells_out(cells: np.ndarray, most: int) -> bytes:
    """Sorted cells below ``most``, as bits if that is no longer than a list."""
    if 4 * len(cells) < -(-most // 8):
        return cells.astype(np.int32).tobytes()
    bits = np.zeros(most, bool)
    bits[cells] = True
    return np.packbits(bits).tobytes()


def cells_in(data: bytes, most: int) -> np.ndarray:
    if len(data) < -(-most // 8):
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=most))


def counts_out(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold the greatest, or as they are."""
    greatest = values.max(initial=0.0)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if greatest <= np.iinfo(k).max), np.float64)
    return values.astype(kind).tobytes()


def counts_in(data: bytes, number: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}.get(len(data) // max(1, number), np.float64)
    return np.frombuffer(data, kind).astype(np.float64)


def _spread(acc: np.ndarray, come_from: np.ndarray, to: np.ndarray, cells: np.ndarray, values: np.ndarray) -> None:
    """Add the values of nodes to what their links, sorted by ``to``, lead to."""
    size, width = acc.shape
    at, column = cells // width, cells % width
    active = np.zeros(size, bool)
    active[at] = True
    links = np.bincount(come_from, minlength=size)
    each = links[at]
    if SINGLY * each.sum() < width * links[active].sum():
        _sent_singly(acc, to[np.argsort(come_from, kind="stable")], np.cumsum(links) - links, at, column, each, values)
        return
    sent = np.zeros(size * width)
    sent[cells] = values
    sent = sent.reshape(size, width)
    keep = active[come_from]
    come_from, to = come_from[keep], to[keep]
    step = max(1, GATHERED // width)
    for start in range(0, len(to), step):
        ends = to[start : start + step]
        starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        acc[ends[starts]] += np.add.reduceat(sent[come_from[start : start + step]], starts, axis=0)


def _sent_singly(acc: np.ndarray, to: np.ndarray, first: np.ndarray, at: np.ndarray, column: np.ndarray,
                 each: np.ndarray, values: np.ndarray) -> None:
    """The same for few cells, one by one. ``to`` is sorted by where links come from, ``first`` a node's first place there, ``each``
    the links of each cell's node."""
    flat, width = acc.reshape(-1), acc.shape[1]
    ends = np.cumsum(each)
    cuts = np.searchsorted(ends, np.arange(GATHERED, ends[-1] if len(ends) else 0, GATHERED), side="right")
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        own = each[a:b]
        sent = np.cumsum(own)
        place = np.arange(sent[-1] if len(sent) else 0) + np.repeat(first[at[a:b]] - sent + own, own)
        np.add.at(flat, to[place].astype(np.int64) * width + np.repeat(column[a:b], own), np.repeat(values[a:b], own))


def _kernel(size: int, width: int, read: Callable, finish: Callable, names: list[str]) -> Callable[[Iterator], Iterator]:
    """Rows of ``MET``, sorted: per group and block, the sums of what arrives along links, then ``finish``. ``read`` turns the bytes
    that arrive into so many values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, links, acc = None, None, None, None
        for batch in batches:
            for g, b, part, kind, x, y, z, t, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, b) != now:
                    if own is not None:
                        yield pa.RecordBatch.from_pydict(finish(*now, acc, *own), schema=names)
                    now, own, acc = (g, b), None, np.zeros((size, width))
                if kind == OWN:
                    own = (x, y, z, np.frombuffer(t), np.frombuffer(s))
                elif kind == LINKS:
                    links = part, np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                elif links is not None and links[0] == part:
                    cells = cells_in(x, size * width)
                    _spread(acc, links[1], links[2], cells, read(y, len(cells)))
        if own is not None:
            yield pa.RecordBatch.from_pydict(finish(*now, acc, *own), schema=names)

    return work


def found(size: int, width: int) -> Callable:
    """One level of the search: the cells that something arrives at and that were not visited before."""
    schema = pa.schema([("g", pa.int32()), ("b", pa.int32()), *((n, pa.binary()) for n in ("cells", "sigma", "visited")),
                        ("n", pa.int64()), ("reach", pa.binary()), ("come", pa.binary())])

    def finish(g, b, acc, visited, start, _, t, s):
        flat = acc.ravel()
        if visited is None:  # the sources themselves
            seen = np.zeros(size * width, bool)
            flat[np.frombuffer(start, np.int32)] = 1.0
        else:
            seen = np.unpackbits(np.frombuffer(visited, np.uint8), count=size * width).astype(bool)
            flat[seen] = 0.0
        cells = np.flatnonzero(flat).astype(np.int32)
        seen[cells] = True
        at, column = cells // width, cells % width
        return {
            "g": [g], "b": [b], "cells": [cells_out(cells, size * width)], "sigma": [counts_out(flat[cells])],
            "visited": [np.packbits(seen).tobytes()], "n": [len(cells)],
            "reach": [np.bincount(column, t[at], width).tobytes()], "come": [np.bincount(at, s[column], size).tobytes()],
        }

    return _kernel(size, width, counts_in, finish, schema)


def depended(size: int, width: int) -> Callable:
    """One level back: what the level's nodes gain from the next one, and what the level before is to receive."""
    schema = pa.schema([("g", pa.int32()), ("b", pa.int32()), *((n, pa.binary()) for n in ("cells", "quotient", "score", "square"))])

    def finish(g, b, acc, cells, sigma, _, t, s):
        at = cells_in(cells, size * width)
        sigma = counts_in(sigma, len(at))
        delta = sigma * acc.ravel()[at]
        at, column = at // width, at % width
        return {
            "g": [g], "b": [b], "cells": [cells], "quotient": [((t[at] + delta) / sigma).tobytes()],
            "score": [np.bincount(at, s[column] * delta, size).tobytes()],
            "square": [np.bincount(at, s[column] * delta * delta, size).tobytes()],
        }

    return _kernel(size, width, lambda data, _: np.frombuffer(data), finish, schema)


def unpacked(rows: DataFrame, key: str, step: int, *names: str) -> DataFrame:
    """place and the numbers of binary columns: of ``key`` times ``step``, plus the position; rows of zeros left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.stack([np.frombuffer(v) for v in values])
                at = np.flatnonzero(values.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + k * step, pa.int64()), *(pa.array(v[at]) for v in values)], ["place", *names]
                )

    wanted = ", ".join(["place long", *(f"{n} double" for n in names)])
    return rows.select(key, *names).mapInArrow(work, wanted)


def meet(own: DataFrame, links: DataFrame, arriving: DataFrame | None, targets: DataFrame, sources: DataFrame,
         kernel: Callable, schema: str, partitions: int, blocks: int) -> DataFrame:
    """Run a kernel on ``own`` (g, b, x, y), with the packed links (part, b, come_from, to) and what arrives (g, part, x, y) of
    other blocks."""
    none = "cast(NULL AS binary)"
    rows = own.join(F.broadcast(targets), "b").join(F.broadcast(sources), "g").selectExpr(
        "g", "b", "-1 AS part", f"{OWN} AS kind", "x", "y", f"{none} AS z", "t", "s"
    )
    if arriving is not None:
        sent = arriving.join(F.broadcast(links.select("part", "b")), "part")
        rows = rows.union(sent.selectExpr(
            "g", "b", "part", f"{ARRIVING} AS kind", "x", "y", f"{none} AS z", f"{none} AS t", f"{none} AS s"
        )).union(links.join(F.broadcast(arriving.select("g", "part")), "part").selectExpr(
            "g", "b", "part", f"{LINKS} AS kind", "come_from", "to", f"{none}", f"{none}", f"{none}"
        ))
    dealt = rows.repartitionById(partitions, F.expr(f"cast(pmod(g * {blocks} + b, {partitions}) AS int)"))
    return dealt.sortWithinPartitions("g", "b", "part", "kind").select(*MET).mapInArrow(kernel, schema)
