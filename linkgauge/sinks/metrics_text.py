"""Metrics as delimited text, for interchange, and as Parquet, the main form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.degrees import in_degree
from ..schema import METRICS, Graph, GraphError, require_columns

# Header line, separators and file names of the text form.
HEADER_TEXT = "* NodeId || InDegree(CiteCnt) || pageRank || pageRankNormalized || betweenness || nodeName"
SEP_SPACED = " || "
SEP_TIGHT = "||"
METRICS_SUFFIX = "_metrics.txt"
MAP_REDUCE_SUFFIX = "MapReduce.txt"
STATIC_RANK_PREFIX = "SortedPageRank"
BETWEENNESS_PREFIX = "SortedBetweeness"
SORTED_NAME = "Test_Sorted_{name}.csv"


def rendered(metrics: DataFrame, sep: str = SEP_SPACED) -> DataFrame:
    """One text row per metrics row, in column ``value``.

    Two pipes separate the fields because names may hold a single one.
    """
    require_columns(metrics, METRICS.fieldNames(), "metrics")
    fields: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in METRICS.fieldNames()]
    return metrics.select(F.concat_ws(sep, *fields).alias("value"))


def write_metrics_text(metrics: DataFrame, path: str, sep: str = SEP_SPACED, header: bool = True) -> None:
    """Write text parts. The header is a part of its own, before all others, so the
    parts put together in name order are the one file; sorted rows stay sorted."""
    text = rendered(metrics, sep)
    if header:
        head = metrics.sparkSession.range(1, numPartitions=1).select(F.lit(HEADER_TEXT).alias("value"))
        text = head.union(text)
    text.write.text(path)


def write_metrics_parquet(metrics: DataFrame, path: str) -> None:
    require_columns(metrics, METRICS.fieldNames(), "metrics")
    metrics.select(*METRICS.fieldNames()).write.parquet(path)


def _of_scores(scores: DataFrame, graph: Graph, values: dict[str, Column]) -> DataFrame:
    """Metrics rows for given scores: one row per score, every id known to the graph.

    Scores may be keyed by ids of another type, such as numbers for a graph whose ids are
    text; they are cast to the graph's. An id that this makes null counts as unknown.
    """
    scores = scores.withColumn("id", F.col("id").try_cast(graph.vertices.schema["id"].dataType))
    unknown = [row["id"] for row in scores.join(graph.vertices, "id", "left_anti").select("id").limit(5).collect()]
    if unknown:
        raise GraphError(f"scores for unknown nodes, among them {unknown}")
    known = graph.vertices.select("id", "name").join(in_degree(graph.vertices, graph.edges), "id")
    columns = {"page_rank": F.lit(0), "page_rank_normalized": F.lit(0), "betweenness": F.lit(0.0)} | values
    return scores.join(known, "id").select("id", "in_degree", *[c.alias(n) for n, c in columns.items()], "name")


def static_rank_metrics(scores: DataFrame, graph: Graph, betweenness: DataFrame | None = None) -> DataFrame:
    """Metrics rows from an unnormalised rank (``id, page_rank``): the given value
    counts as normalised, and divided by the link count as the rank.

    ``betweenness`` (``id, betweenness``) is a node's own where given, else 0.
    """
    links = graph.header.first()["num_link"]
    rank = F.col("page_rank")
    values = {"page_rank": rank / F.lit(float(links)), "page_rank_normalized": rank}
    if betweenness is not None:
        scores = scores.select("id", "page_rank").join(betweenness.select("id", "betweenness"), "id", "left")
        values["betweenness"] = F.coalesce("betweenness", F.lit(0.0))
    return _of_scores(scores, graph, values)


def betweenness_metrics(scores: DataFrame, graph: Graph) -> DataFrame:
    """Metrics rows from betweenness alone (``id, betweenness``); both ranks are 0."""
    return _of_scores(scores, graph, {"betweenness": F.col("betweenness")})


def write_static_rank(
    scores: DataFrame, graph: Graph, folder: str, name: str, betweenness: DataFrame | None = None
) -> str:
    path = f"{folder}/{STATIC_RANK_PREFIX}{name}"
    write_metrics_text(static_rank_metrics(scores, graph, betweenness), path, SEP_TIGHT)
    return path


def write_betweenness(scores: DataFrame, graph: Graph, folder: str, name: str) -> str:
    path = f"{folder}/{BETWEENNESS_PREFIX}{name}"
    write_metrics_text(betweenness_metrics(scores, graph), path, SEP_TIGHT)
    return path
