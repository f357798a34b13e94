"""Exact top-k search with segment statistics at several resolutions.

Vectors are cut into 1, 2, 4 and 8 segments. The means and deviations of two vectors' segments bound
their distance from below, and so, with their lengths, their inner product from above; a candidate whose bound at a coarse resolution is
under the query's k-th best score so far is dropped before the next one is computed. Survivors get exact products.

Scale: queries are rows of the table, so there may be many; neither side is broadcast or collected. Both are dealt into blocks of
bounded size by hash, and every pair of a query block and a candidate block is one group: a candidate is sent once for
each ``QUERY_BLOCK`` queries. Groups return k rows for each query, merged by query.

Defined cases: a null vector, or one with null or non-finite components, takes no part. Of vectors of unequal length the shorter ends in zeros.
Rows with equal id and vector are counted together and returned as often as they are; a query's own row is left out once.
A null id is after all others and no query. Scores beyond 64 bits are cut to that range. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, store

K = 5
EVERY = 50
SCALE = 256.0
RESOLUTIONS = (1, 2, 4, 8)
QUERY_BLOCK, CANDIDATE_BLOCK = 20_000, 65_536
#: Rows of a block that are compared at a time.
QUERY_ROWS, CANDIDATE_ROWS = 256, 4096
NO_ID = np.iinfo(np.int64).max


def quantized(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE * x) of all components, ended with zeros to the width, as doubles."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(SCALE * out)


def summaries(rows: np.ndarray) -> list[np.ndarray]:
    """For each resolution the features whose product bounds the product of two rows from above.

    For segments of n components with mean m and deviation s (the length of what the mean leaves over),
    x . y = sum n mx my + rests <= sum n mx my + sx sy.
    """
    finest = RESOLUTIONS[-1]
    wide = np.zeros((len(rows), -(-rows.shape[1] // finest) * finest))
    wide[:, : rows.shape[1]] = rows
    out = []
    for number in RESOLUTIONS:
        cut = wide.reshape(len(wide), number, -1)
        mean = cut.mean(axis=2)
        rest = np.sqrt(np.square(cut - mean[:, :, None]).sum(axis=2))
        out.append(np.concatenate((mean * math.sqrt(cut.shape[2]), rest), axis=1))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    found = [[sum(x * y for x, y in zip(map(int, row), other)) for other in whole] for row in a]
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(v, low), high) for v in row] for row in found], np.int64).reshape(len(a), len(b))


class _Best:
    """The k best (score, id, copies, row of the candidate) of each query."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.threshold = np.full(queries, -np.inf)
        self.query = np.empty(0, np.int64)
        self.score, self.ids, self.copies = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        query, score, ids, copies = (
            np.concatenate(x) for x in zip((self.query, self.score, self.ids, self.copies), (query, score, ids, copies))
        )
        order = np.lexsort((ids, -score.astype(np.float64), query))
        # doubles may tie where whole numbers don't
        order = order if np.abs(score).max(initial=0) < 2**53 else np.array(
            sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), ids[i])), np.int64)
        query, score, ids, copies = (x[order] for x in (query, score, ids, copies))
        heads = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(query)]))))
        keep = rank < self.k
        self.query, self.score, self.ids, self.copies = (x[keep] for x in (query, score, ids, copies))
        last = np.flatnonzero(rank[keep] == self.k - 1)
        self.threshold[self.query[last]] = self.score[last]


def searched(queries: pd.DataFrame, candidates: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """Rows (query_id, query_key, score, vec_id, copies): the k best of these candidates for each of these queries."""
    if queries.empty or candidates.empty:
        return pd.DataFrame(columns=["query_id", "query_key", "score", "vec_id", "copies"], dtype="int64")
    width = max([1, *queries["vector"].map(len), *candidates["vector"].map(len)])
    a, b = quantized(queries["vector"], width), quantized(candidates["vector"], width)
    ids = candidates["vec_id"].to_numpy()
    copies, keys = candidates["copies"].to_numpy(), candidates["key"].to_numpy()
    sums_a, sums_b = summaries(a), summaries(b)
    # what rounding may take from a bound
    slack = 1e-9 * (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1).max(initial=0) + 1)
    out = []
    for at in range(0, len(a), QUERY_ROWS):
        own = slice(at, at + QUERY_ROWS)
        best = _Best(len(a[own]), k)
        query_ids, query_keys = queries["vec_id"].to_numpy()[own], queries["key"].to_numpy()[own]
        for begin in range(0, len(b), CANDIDATE_ROWS):
            rows = np.arange(begin, min(begin + CANDIDATE_ROWS, len(b)))
            floor = (best.threshold[:, None] - slack[own])
            for sa, sb in zip(sums_a, sums_b):
                rows = rows[(sa[own] @ sb[rows].T >= floor).any(axis=0)]
            if not len(rows):
                continue
            scores = _products(a[own], b[rows])
            number = np.broadcast_to(copies[rows], scores.shape) - (
                (query_ids[:, None] == ids[rows]) & (query_keys[:, None] == keys[rows])
            )
            q, c = np.nonzero((scores >= best.threshold[:, None]) & (number > 0))
            best.add(q, scores[q, c], ids[rows[c]], number[q, c])
        out.append(pd.DataFrame({
            "query_id": query_ids[best.query], "query_key": query_keys[best.query], "score": best.score,
            "vec_id": best.ids, "copies": best.copies,
        }))
    return pd.concat(out)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(_usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    rows = store(rows.withColumn("key", F.xxhash64("vector")))
    of_queries = (F.col("vec_id") % every == 0)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(of_queries).alias("q")).first()
    wide = max(spark.sparkContext.defaultParallelism, math.ceil(sizes["n"] / CANDIDATE_BLOCK))
    high = max(1, math.ceil(sizes["q"] / QUERY_BLOCK))
    block = F.xxhash64("vec_id", "key")
    candidates = rows.select(
        F.pmod(block, F.lit(wide)).alias("of_candidates"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("of_queries"),
        F.coalesce("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "vector", "copies", "key",
    )
    queries = rows.where(of_queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("of_candidates"), F.pmod(block, F.lit(high)).alias("of_queries"),
        "vec_id", "vector", "key",
    )

    def work(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return searched(own, others, k)

    keys = [F.col("of_candidates").cast("long"), F.col("of_queries").cast("long")]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        work, "query_id long, query_key long, score long, vec_id long, copies long"
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumn("before", before).where(F.col("before") < k)
    ranked = expand(ranked.withColumn("taken", F.least(F.col("copies"), k - F.col("before"))), "taken", "n")
    times = rows.where(of_queries).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("copies").alias("times"))
    each = expand(ranked.drop("copies").join(times, ["query_id", "query_key"]), "times", "time")
    return each.select(
        "query_id", (F.col("before") + F.col("n") + 1).cast("int").alias("rank"),
        F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score",
    )
