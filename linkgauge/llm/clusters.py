"""Centroid clustering with a vantage-point tree over the centroids.

Every round builds a tree of the present centroids and broadcasts it. Tasks search it for the nearest centroid of
each vector: subtrees wait with a lower bound of their distance, that with the least bound is opened first, and
a vector is done when the least bound exceeds the distance of the best centroid found. A bound that equals it is still opened, so that ties
go to the smaller number. Distances to centroids are exact whole numbers; bounds, which need square roots, give way by more than
their rounding error.

The searches of a batch run side by side, one opened subtree for each vector a step.

Scale: vectors are narrowed to whole numbers in a stored table once and read where they lie each round; a task passes on one
row of sums per cluster and component. Driver and broadcast hold clusters times components numbers, whatever the number of vectors.

Defined cases: vectors that are null, have another dimension, or hold null or non-finite components take no part. Rows with the same id
are vectors each; of these a starting centroid takes the lesser vector first. A null id hashes like an empty text. With fewer vectors than
clusters there are as many clusters as vectors. Components whose scaled value exceeds 2**27 in size raise, as squares would overflow.
An empty table gives an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .vectors import matrix, whole_vectors

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 16, 3, 64, 64, "1"
MOST = 1 << 27
#: Centroids of a leaf at most.
LEAF = 3
#: Share of the distances it comes from that a bound gives way, some hundred times what rounding can do to it.
SLACK = 1e-13
#: Waiting bounds, vectors times subtrees, that a task holds at a time.
HELD = 1 << 20


class VantageTree:
    """A tree of points. An inner node has its vantage point and two children, and for each child the least and greatest distance of its
    points from the vantage point; a leaf has up to ``LEAF`` points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.members: list[list[int]] = []
        self.children: list[tuple[int, int]] = []
        self.ranges: list[list[tuple[float, float]]] = []
        self._add(list(range(len(points))), leaf)
        width = max(map(len, self.members))
        #: Points of each node, -1 where it has fewer; the vantage point of an inner node alone.
        self.members = np.array([m + [-1] * (width - len(m)) for m in self.members])
        self.children = np.array(self.children)
        self.ranges = np.array(self.ranges)

    def _add(self, own: list[int], leaf: int) -> int:
        node = len(self.members)
        self.members.append(own)
        self.children.append((-1, -1))
        self.ranges.append([(0.0, 0.0)] * 2)
        if len(own) > leaf:
            centre = self.points[own].mean(axis=0)
            far = ((self.points[own] - centre) ** 2).sum(axis=1)
            vantage = own[int(far.argmax())]
            rest = np.array([i for i in own if i != vantage])
            away = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(away, kind="stable")
            parts = np.array_split(order, 2)
            self.members[node] = [vantage]
            self.ranges[node] = [(away[p[0]], away[p[-1]]) if len(p) else (0.0, 0.0) for p in parts]
            self.children[node] = tuple(self._add(rest[p].tolist(), leaf) if len(p) else -1 for p in parts)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest point, squared distance) of each vector, and how many distances that took."""
        found = [self._search(part) for part in self._parts(vectors)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _parts(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, HELD // len(self.members))
        for at in range(0, len(vectors), step):
            yield vectors[at : at + step]

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        rows = len(vectors)
        waiting = np.full((rows, len(self.members)), np.inf)
        waiting[:, 0] = 0.0
        best = np.full(rows, np.iinfo(np.int64).max)
        which = np.full(rows, len(self.points))
        live, taken = np.arange(rows), 0
        while len(live):
            node = waiting[live].argmin(axis=1)
            bound = waiting[live, node]
            radius = np.sqrt(best[live].astype(np.float64)) * (1 + SLACK)
            go = np.isfinite(bound) & (bound <= radius)
            live, node, bound = live[go], node[go], bound[go]
            waiting[live, node] = np.inf
            for slot in range(self.members.shape[1]):
                point = self.members[node, slot]
                there = point >= 0
                at, point = live[there], point[there]
                off = vectors[at] - self.points[point]
                square = np.einsum("ij,ij->i", off, off)
                taken += len(at)
                better = (square < best[at]) | ((square == best[at]) & (point < which[at]))
                best[at[better]], which[at[better]] = square[better], point[better]
                if slot == 0:
                    away = np.sqrt(square.astype(np.float64))
            for side in range(2):
                child = self.children[node, side]
                inner = child >= 0
                low, high = self.ranges[node[inner], side].T
                d = away[inner]
                least = np.maximum(low - d, d - high) - (d + high) * SLACK
                waiting[live[inner], child[inner]] = np.maximum(bound[inner], least)
        return which, best, taken


def _first(vectors: DataFrame, clusters: int, dimension: int, seed: str) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), dimension)


def _summed(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors, or themselves where they have none."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    number, width = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((number, width + 1), np.int64)
        for batch in batches:
            own = matrix(batch.column(0), width)
            which = shared.value.nearest(own)[0]
            np.add.at(sums[:, :width], which, own)
            sums[:, width] += np.bincount(which, minlength=number)
        cluster, part = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(sums[cluster, part])], ["cluster", "part", "total"]
        )

    partial = vectors.select("vector").mapInArrow(work, "cluster int, part int, total long")
    after = centroids.copy()
    rows = partial.groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    counts = {r["cluster"]: r["total"] for r in rows if r["part"] == width}
    for cluster in counts:
        after[cluster] = 0
    for r in rows:
        if r["part"] < width:
            after[r["cluster"], r["part"]] = r["total"] // counts[r["cluster"]]
    shared.unpersist()
    return after


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Stored rows (vec_id, cluster, distance)."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    width = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, square, _ = shared.value.nearest(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(which, pa.int32()), pa.array(square)], ["vec_id", "cluster", "distance"]
            )

    return store(vectors.mapInArrow(work, "vec_id long, cluster int, distance long"))


def clustered(
    vectors: DataFrame, id: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimension: int = DIMENSION, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance), one for each vector that takes part, and the final centroids."""
    rows = store(whole_vectors(vectors.where(F.size(column) == dimension), id, column, scale, MOST))
    centroids = _first(rows, clusters, dimension, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _summed(rows, centroids)
    return _assigned(rows, centroids), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``clustered`` with cluster_inertia, inertia and centroid_sha256."""
    sums = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    total = sum(sums.values())
    named = [
        (c, sums.get(c, 0), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids.tolist())
    ]
    side = rows.sparkSession.createDataFrame(
        named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    joined = rows.join(F.broadcast(side), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
