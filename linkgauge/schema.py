"""Fixed schemas of the tables this package exchanges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERTICES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("node_weight", T.DoubleType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

HEADER = T.StructType(
    [
        T.StructField("num_node", T.LongType()),
        T.StructField("num_link", T.LongType()),
        T.StructField("node_lines", T.LongType()),
        T.StructField("link_lines", T.LongType()),
        T.StructField("total_node_weight", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("in_degree", T.LongType()),
        T.StructField("page_rank", T.DoubleType()),
        T.StructField("page_rank_normalized", T.DoubleType()),
        T.StructField("betweenness", T.DoubleType()),
        T.StructField("name", T.StringType()),
    ]
)


#: Column of edges that are not stored yet: link rows behind the pair.
LINES = "_lines"


class GraphError(ValueError):
    """A graph, or the text it comes from, breaks a rule of the data model."""


def require_columns(frame: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise GraphError(f"{what} lacks column(s) {missing}; it has {frame.columns}")


@dataclass(frozen=True)
class Graph:
    """A directed, weighted graph held as tables.

    vertices  id, name, node_weight          one row per node
    edges     src, dst, weight               one row per ordered pair
    header    one row of counts and totals, see HEADER

    Ids are compared by value. They may be of any one type; text readers give
    strings. ``vertices_from_links`` notes that the vertices are just the endpoints of
    the edges, and ``checked`` that no link is known to name another node; algorithms
    check other graphs first. Before a graph is stored its edges may carry LINES, the
    number of link rows behind each pair.
    """

    vertices: DataFrame
    edges: DataFrame
    header: DataFrame
    vertices_from_links: bool = False
    checked: bool = False

    def __post_init__(self) -> None:
        require_columns(self.vertices, VERTICES.fieldNames(), "vertices")
        require_columns(self.edges, EDGES.fieldNames(), "edges")
        require_columns(self.header, HEADER.fieldNames(), "header")
