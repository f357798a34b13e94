"""The whole job: degree, PageRank and betweenness of every node in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import or_zero
from ..operators.degrees import in_degree
from ..operators.pagerank import normalized, pagerank
from ..operators.paths import betweenness
from ..schema import METRICS, Graph, require_columns
from ..sinks.metrics_text import SEP_SPACED, write_metrics_text
from ..sources.metrics_text import read_metrics
from ..sources.pajek import read_pajek


def metrics_table(
    graph: Graph, rank: DataFrame | None = None, scores: DataFrame | None = None, with_betweenness: bool = True
) -> DataFrame:
    """id, in_degree, page_rank, page_rank_normalized, betweenness, name.

    ``rank`` (id, page_rank) and ``scores`` (id, betweenness) are computed with
    defaults unless given; without betweenness that column is 0.
    """
    rank = pagerank(graph) if rank is None else rank
    if scores is None and with_betweenness:
        scores = betweenness(graph)
    table = (
        graph.vertices.select("id", "name")
        .join(in_degree(graph.vertices, graph.edges), "id")
        .join(normalized(rank.select("id", "page_rank"), graph), "id", "left")
    )
    if scores is None:
        table = table.withColumn("betweenness", F.lit(0.0))
    else:
        table = table.join(scores.select("id", "betweenness"), "id", "left")
        table = table.withColumn("betweenness", or_zero(F.col("betweenness")))
    return table.select(*METRICS.fieldNames())


def network_metrics(spark: SparkSession, path: str, out: str, with_betweenness: bool = False, sep: str = SEP_SPACED) -> DataFrame:
    """Read a Pajek network, compute the metrics table and write it as text."""
    table = metrics_table(read_pajek(spark, path), with_betweenness=with_betweenness)
    write_metrics_text(table, out, sep)
    return table


def sorted_metrics(metrics: DataFrame, by: str = "betweenness") -> DataFrame:
    """Rows ascending by one column, ties by id."""
    require_columns(metrics, [by, "id"], "metrics")
    return metrics.orderBy(F.col(by).asc(), F.col("id").asc())


def sort_metrics_file(spark: SparkSession, path: str, out: str, by: str = "betweenness", sep: str = SEP_SPACED) -> None:
    """Read metrics text and write it sorted."""
    write_metrics_text(sorted_metrics(read_metrics(spark, path), by), out, sep)
