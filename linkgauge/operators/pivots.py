"""Betweenness estimated from searches of sampled sources, with a bound on every node's error.

A node's betweenness is the sum of its dependencies over all sources. Sources taken at random without replacement, the pivots, give their
mean, which the number of sources scales up. How far a mean may be off follows from the dependencies' own spread
(an empirical Bernstein-Serfling bound: Bardenet and Maillard, Concentration inequalities for sampling without
replacement, 2015), so nodes that few paths pass through are known sooner than a bound by the range alone would say.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import or_zero
from ..schema import Graph
from .paths import SCORES, _Searches
from .positions import with_position

# Pivots of the first round; every other round doubles them.
FIRST = 64

# Fixed values of the bound: the factor of its range term, and how many times its failure counts on both sides together.
RANGE_FACTOR = 7 / 3 + 3 / math.sqrt(2)
FAILURES = 10


def pivot_rounds(nodes: int, pivots: int | None = None) -> list[int]:
    """How many pivots there are after each round, all nodes at last; just one round if their number is given."""
    if pivots is not None:
        return [max(1, min(pivots, nodes))]
    sizes = [FIRST << i for i in range(64) if FIRST << i < nodes]
    return [*sizes, nodes]


def error_terms(nodes: int, rounds: int, pivots: int, failure: float) -> tuple[float, float]:
    """(factor of the standard deviation, what is added) of the bound on a mean of values from 0 to 1, such that all bounds of all
    nodes and rounds hold together but for a probability of ``failure``."""
    if pivots >= nodes:
        return 0.0, 0.0
    log = math.log(FAILURES * nodes * rounds / failure)
    if 2 * pivots <= nodes:
        left = 1 - (pivots - 1) / nodes
    else:
        left = (1 - pivots / nodes) * (1 + 1 / pivots)
    return math.sqrt(2 * left * log / pivots), RANGE_FACTOR * log / pivots


def betweenness_estimate(
    graph: Graph, error: float = 0.01, failure: float = 0.05, pivots: int | None = None, seed: int = 0,
    batch_rows: int | None = None, partitions: int | None = None, job: str | None = None,
) -> DataFrame:
    """id, betweenness, error, pivots: betweenness as ``betweenness`` defines it, estimated.

    Pivots are doubled until no node's error is more than ``error`` times the most that a graph of so many nodes allows,
    n * (n - 2). If that takes all nodes, the result is exact and its errors are 0. All errors hold together
    but for a probability of ``failure``. ``pivots`` fixes their number instead; the errors then say what that gave.

    Pivots are the first nodes by the digest of ``seed`` and id, so another run takes the same ones. They are searched on the
    graph as it is: taking leaves off needs what every node of the core reaches. ``job`` is as for ``betweenness``, with
    the same seed.
    """
    searches = _Searches(graph, None, batch_rows, partitions, job)
    nodes = searches.count
    if not nodes:
        return graph.vertices.selectExpr("id", "0D AS betweenness", "0D AS error", "0L AS pivots").where(F.lit(False))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    order = with_position(searches.numbers.select("id", "key", digest.alias("digest")), [F.col("digest"), F.col("id")], "place")
    links = searches.links
    rounds, most, taken = pivot_rounds(nodes, pivots), max(1, nodes - 2), 0
    for at, size in enumerate(rounds):
        chosen = order.where(F.col("place").between(taken + 1, size))
        searches.starts = chosen.select("key", F.lit(1.0).alias("s"))
        searches._size(size - taken, nodes, links)
        for batch in searches.blocks(f"round-{at}-", squared=True):
            with searches.ledger.step(batch.step) as attempt:
                batch.add_scores(attempt)
        taken = size
        by_spread, added = error_terms(nodes, len(rounds), size, failure)
        found = searches.ledger.read(SCORES, *[f"round-{i}-" for i in range(at + 1)]).groupBy("key").agg(
            F.sum("score").alias("score"), F.sum("square").alias("square")
        )
        mean, square = F.col("score") / F.lit(float(size * most)), F.col("square") / F.lit(float(size) * most**2)
        spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
        found = found.select("key", mean.alias("mean"), (spread * F.lit(by_spread) + F.lit(added)).alias("off"))
        # a node that no path passes through has no row, and the least bound of all
        worst = max(added, found.agg(F.max("off").alias("off")).first()["off"] or 0.0)
        if worst <= error:
            break
    scale = float(nodes * most)
    scored = graph.vertices.select("id").join(
        searches.with_ids(found.withColumnRenamed("key", "id"), "id"), "id", "left"
    )
    return scored.select(
        "id", (or_zero(F.col("mean")) * F.lit(scale)).alias("betweenness"),
        (F.coalesce("off", F.lit(added)) * F.lit(scale)).alias("error"), F.lit(taken).cast("long").alias("pivots"),
    )
