"""Teleport weights, shares of outgoing links, dangling nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .layout import join_per_end

TELEPORT_RULES = ("total_weight", "count")


def teleport_divisor(graph: Graph, rule: str) -> float:
    """What node weights are divided by: the total weight of all node lines, or the
    number of nodes. The two agree only if the mean node weight is 1."""
    if rule not in TELEPORT_RULES:
        raise ValueError(f"teleport must be one of {TELEPORT_RULES}, not {rule!r}")
    header = graph.header.first()
    return float(header["total_node_weight"] if rule == "total_weight" else header["num_node"])


def teleport_weights(graph: Graph, rule: str = "total_weight") -> DataFrame:
    """id, teleport: the share of the random walkers that restart at each node."""
    divisor = teleport_divisor(graph, rule)
    return graph.vertices.select("id", (F.col("node_weight") / F.lit(divisor)).alias("teleport"))


def out_weight_share(edges: DataFrame) -> DataFrame:
    """src, dst, share: each link's part of the weight that leaves its source."""
    totals = edges.groupBy("src").agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("out_weight"))
    joined = join_per_end(edges, totals, "src")
    return joined.select("src", "dst", (F.col("weight") / F.col("out_weight")).alias("share"))


def out_degree_share(edges: DataFrame) -> DataFrame:
    """src, dst, share: one over the number of links that leave the source."""
    totals = edges.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    return join_per_end(edges, totals, "src").select("src", "dst", (F.lit(1.0) / F.col("links")).alias("share"))


def dangling_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id of every node no link leaves."""
    sources = edges.select(F.col("src").alias("id")).distinct()
    return vertices.select("id").join(sources, "id", "left_anti")


def dangling_mass(vertices: DataFrame, edges: DataFrame, rank: DataFrame) -> DataFrame:
    """One row: the number of dangling nodes and the rank (``id, page_rank``) they hold."""
    held = dangling_nodes(vertices, edges).join(rank, "id", "left")
    return held.agg(
        F.count(F.lit(1)).alias("dangling_count"),
        F.coalesce(F.sum("page_rank"), F.lit(0.0)).alias("dangling_mass"),
    )
