"""Graphs from any table of links."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positive_or_one
from ..functions.exact import exact_total
from ..plans.loop import store
from ..schema import LINES, Graph, GraphError


def links_last_wins(links: DataFrame, order: Column | str | None, distinct: bool = False) -> DataFrame:
    """One row per ordered pair, with the number of its link rows in LINES: of several
    links the last one's weight counts, or without ``order`` the greatest one's.

    Aggregates before the shuffle, so many copies of one pair stay cheap.
    ``order`` must be unique within a pair. A caller who knows that there is one link
    per pair already says ``distinct``; links then pass through without a shuffle.
    """
    if distinct:
        return links.select("src", "dst", "weight", F.lit(1).cast("long").alias(LINES))
    weight = F.max("weight") if order is None else F.max_by("weight", order)
    return links.groupBy("src", "dst").agg(weight.alias("weight"), F.count(F.lit(1)).alias(LINES))


def endpoints(edges: DataFrame) -> DataFrame:
    """The nodes that occur in links, named by their id, with weight 1.0."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.select("id", F.col("id").cast("string").alias("name"), F.lit(1.0).alias("node_weight"))


def graph_from_edges(
    links: DataFrame,
    src: str = "src",
    dst: str = "dst",
    weight: str | None = None,
    order: str | None = None,
    vertices: DataFrame | None = None,
    id: str = "id",
    name: str | None = None,
    node_weight: str | None = None,
    distinct: bool = False,
) -> Graph:
    """A graph from a table of links and, optionally, a table of nodes.

    The link count of the graph counts all rows of ``links``, also those that
    give way to another one of their pair (see ``links_last_wins``). Everything stays lazy.
    """
    rows = links.select(
        F.col(src).alias("src"),
        F.col(dst).alias("dst"),
        (positive_or_one(F.col(weight)) if weight else F.lit(1.0)).alias("weight"),
        *([F.col(order).alias("_order")] if order else []),
    )
    edges = links_last_wins(rows, "_order" if order else None, distinct)
    if vertices is None:
        nodes = endpoints(edges)
    else:
        nodes = vertices.select(
            F.col(id).alias("id"),
            F.col(name or id).cast("string").alias("name"),
            (positive_or_one(F.col(node_weight)) if node_weight else F.lit(1.0)).alias("node_weight"),
        )
    return Graph(nodes, edges, _counts(nodes, edges), vertices_from_links=vertices is None)


def _counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lines = F.col(LINES) if LINES in edges.columns else F.lit(1)
    per_side = nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.lit(0).cast("long").alias("links"),
        F.lit(0.0).alias("total"),
    ).union(edges.agg(F.lit(0).cast("long"), F.coalesce(F.sum(lines), F.lit(0)), F.lit(0.0)))
    total = exact_total(nodes, "node_weight").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "total")
    per_side = per_side.union(total)
    return per_side.agg(
        F.sum("nodes").alias("num_node"),
        F.sum("links").alias("num_link"),
        F.sum("nodes").alias("node_lines"),
        F.sum("links").alias("link_lines"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_node_weight"),
    )


def header_row(spark, num_node, num_link, node_lines, link_lines, total_node_weight) -> DataFrame:
    """The one-row header from known scalars."""
    return spark.range(1, numPartitions=1).select(
        F.lit(num_node).cast("long").alias("num_node"),
        F.lit(num_link).cast("long").alias("num_link"),
        F.lit(node_lines).cast("long").alias("node_lines"),
        F.lit(link_lines).cast("long").alias("link_lines"),
        F.lit(float(total_node_weight)).alias("total_node_weight"),
    )


def stored(graph: Graph) -> Graph:
    """The same graph, written once to the shared folder and checked for unknown ends.

    Worth it before any algorithm of many rounds, and whenever the links come
    from an expensive plan, which is evaluated once: every later step, and the
    header, then scans columns of a file.
    """
    edges = store(graph.edges)
    vertices = store(endpoints(edges) if graph.vertices_from_links else graph.vertices)
    counts = (_counts(vertices, edges) if LINES in edges.columns else graph.header).first()
    header = header_row(edges.sparkSession, **counts.asDict())
    return checked(Graph(vertices, edges.select("src", "dst", "weight"), header, graph.vertices_from_links, graph.checked))


def missing_endpoints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that links name but the vertices lack, with the number of such ends."""
    ends = (
        edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("ends"))
        .union(edges.groupBy("dst").agg(F.count(F.lit(1))))
        .groupBy("id").agg(F.sum("ends").alias("ends"))
    )
    return ends.join(vertices, "id", "left_anti")


def check_endpoints(graph: Graph) -> Graph:
    """Raise if a link names an unknown node, else return the graph."""
    unknown = [row["id"] for row in missing_endpoints(graph.vertices, graph.edges).limit(5).collect()]
    if unknown:
        raise GraphError(f"links name unknown nodes, among them {unknown}")
    return replace(graph, checked=True)


def checked(graph: Graph) -> Graph:
    """The graph, after ``check_endpoints`` unless it is known to be sound."""
    return graph if graph.checked or graph.vertices_from_links else check_endpoints(graph)


def check_declared_counts(num_node: int, nodes: int, num_link: int, link_lines: int) -> None:
    """Raise if a file's declared counts differ from what it holds."""
    if num_node != nodes:
        raise GraphError(f"{num_node} nodes declared, {nodes} distinct ids found")
    if num_link != link_lines:
        raise GraphError(f"{num_link} links declared, {link_lines} link lines found")
