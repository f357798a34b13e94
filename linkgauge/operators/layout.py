"""How links are laid out for joins on one of their ends, hubs included.

A node may hold a third of all links. Hashing links by that end would put them all
into one task. With E links in B partitions, an end is a hub if it has more than
E/B links; there are fewer than B hubs, whatever the data, so a table of hubs is
safe to broadcast. All other ends together hash evenly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..plans.loop import hashed, partitions_for, store


def hub_limit(links: int, partitions: int) -> int:
    """Links an end may have without being a hub."""
    return max(1, math.ceil(links / partitions))


@dataclass
class LinksBySource:
    """Links cached for a loop that carries a value from sources to targets.

    ``light`` is hashed by src like the state of the loop, so joining them shuffles
    nothing. ``heavy`` holds the hubs' links, spread by both ends; it meets the few
    hub rows of the state by broadcast.
    """

    light: DataFrame
    heavy: DataFrame | None
    is_hub: str
    nodes: int
    partitions: int

    def inflow(self, shares: DataFrame, value: str, bound: float) -> DataFrame:
        """id, inflow: the sum of ``value`` over a node's incoming links, the same whatever their order; all
        values together are at most ``bound``.
        """
        return self.inflows(shares, inflow=(value, bound))

    def inflows(self, shares: DataFrame, **sums: tuple[str, float]) -> DataFrame:
        """id and several such sums, by name their value and bound.

        ``shares`` (src, share, out_degree) has one row per sending node. Sums are
        formed before the shuffle, so a target hub receives at most one row per task.
        """
        columns = ["dst AS id", *(f"{value} AS {name}" for name, (value, _) in sums.items())]
        # The hash tables hold nodes of one partition, never links.
        sent = self.light.join(hashed(shares, self.nodes, self.partitions), "src").selectExpr(*columns)
        if self.heavy is not None:
            hubs = F.broadcast(shares.where(self.is_hub))
            sent = sent.union(self.heavy.join(hubs, "src").selectExpr(*columns))
        return sent.groupBy("id").agg(*[F.expr(f"{exact_sum(name, bound)} AS {name}") for name, (_, bound) in sums.items()])

    def of(self, sources: DataFrame) -> LinksBySource:
        """The links of some of the sources (src, out_degree), laid out alike."""
        light = self.light.join(hashed(sources.select("src"), self.nodes, self.partitions), "src", "left_semi").persist()
        heavy = self.heavy
        if heavy is not None:
            heavy = heavy.join(F.broadcast(sources.where(self.is_hub).select("src")), "src", "left_semi").persist()
        return LinksBySource(light, heavy, self.is_hub, self.nodes, self.partitions)

    def release(self) -> None:
        self.light.unpersist()
        if self.heavy is not None:
            self.heavy.unpersist()


def links_by_source(
    edges: DataFrame, nodes: DataFrame, count: int, links: int, largest: int, partitions: int
) -> LinksBySource:
    """Lay out ``edges`` by src. ``nodes`` has ``count`` rows of id and out_degree; ``largest``
    is the largest out-degree."""
    limit = hub_limit(links, partitions)
    is_hub = f"out_degree > {limit}"
    if largest <= limit:
        return LinksBySource(edges.repartition(partitions, "src").persist(), None, is_hub, count, partitions)
    hubs = F.broadcast(nodes.where(is_hub).selectExpr("id AS src"))
    light = edges.join(hubs, "src", "left_anti").repartition(partitions, "src").persist()
    heavy = edges.join(hubs, "src", "left_semi").repartition(partitions, "src", "dst").persist()
    return LinksBySource(light, heavy, is_hub, count, partitions)


def join_per_end(edges: DataFrame, totals: DataFrame, end: str) -> DataFrame:
    """Join links with a table of one row per ``end`` that has their count in ``links``."""
    totals = store(totals)
    counts = totals.agg(F.sum("links").alias("links"), F.max("links").alias("largest")).first()
    links, largest = counts["links"] or 0, counts["largest"] or 0
    limit = hub_limit(links, partitions_for(links))
    if largest <= limit:
        return edges.join(totals, end)
    hubs = F.broadcast(totals.where(F.col("links") > limit))
    light = edges.join(hubs.select(end), end, "left_anti").join(totals, end)
    return light.unionByName(edges.join(hubs, end))


@dataclass
class LinksByEnd:
    """Links cached for joins with many rows per node, keyed by one end.

    There may be too many rows of a hub to broadcast. Its links get a salt instead,
    from 0 up to links/limit, and rows that meet them are repeated once per salt.
    """

    links: DataFrame
    end: str
    hubs: DataFrame | None
    partitions: int

    def meet(self, rows: DataFrame, count: int) -> DataFrame:
        """Join ``rows``, of which there are ``count``, to the links by ``end``, a column of both."""
        if self.hubs is None:
            return self.links.join(hashed(rows, count, self.partitions), self.end)
        salted = rows.join(F.broadcast(self.hubs), self.end, "left").selectExpr(
            *rows.columns, "explode(sequence(0, coalesce(salts, 1) - 1)) AS salt"
        )
        return self.links.join(hashed(salted, count, self.partitions), [self.end, "salt"])

    def release(self) -> None:
        self.links.unpersist()
        if self.hubs is not None:
            self.hubs.unpersist()


def links_by_end(edges: DataFrame, end: str, links: int, partitions: int) -> LinksByEnd:
    """Lay out the links ``edges``, with all their columns, by ``end`` with salted hubs."""
    other = "dst" if end == "src" else "src"
    pairs = edges
    limit = hub_limit(links, partitions)
    hubs = (
        pairs.groupBy(end)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select(end, F.ceil(F.col("n") / limit).cast("int").alias("salts"))
        .persist()
    )
    if hubs.isEmpty():
        hubs.unpersist()
        return LinksByEnd(pairs.repartition(partitions, end).persist(), end, None, partitions)
    salted = pairs.join(F.broadcast(hubs), end, "left").select(
        *edges.columns, F.pmod(F.hash(other), F.coalesce("salts", F.lit(1))).alias("salt")
    )
    return LinksByEnd(salted.repartition(partitions, end, "salt").persist(), end, hubs, partitions)
