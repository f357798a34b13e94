"""Degrees: each is one aggregation with map-side combine, so hubs stay cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph


def in_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree: the number of nodes that link to a node (its citation count)."""
    return _degree(vertices, edges, "dst", "in_degree")


def out_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree: the number of links that leave a node."""
    return _degree(vertices, edges, "src", "out_degree")


def _degree(vertices: DataFrame, edges: DataFrame, end: str, name: str) -> DataFrame:
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias(name))


def average_degree(graph: Graph) -> DataFrame:
    """One row: num_node, num_edge and the average number of links per node."""
    sides = graph.vertices.select(F.lit(1).alias("n"), F.lit(0).alias("m")).union(
        graph.edges.select(F.lit(0), F.lit(1))
    )
    counts = sides.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_node"), F.coalesce(F.sum("m"), F.lit(0)).alias("num_edge"))
    return counts.select(
        "num_node", "num_edge", F.try_divide(F.col("num_edge"), F.col("num_node")).cast("double").alias("average_degree")
    )
