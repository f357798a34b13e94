"""Metrics of large directed, weighted networks, as Spark jobs on tables."""

from .operators.degrees import average_degree, in_degree, out_degree
from .operators.pagerank import normalized, pagerank, pagerank_delta, pagerank_static
from .operators.paths import betweenness, shortest_paths, touched_nodes
from .operators.pivots import betweenness_estimate
from .operators.positions import rank_positions, with_position
from .operators.weights import (
    dangling_mass,
    dangling_nodes,
    out_degree_share,
    out_weight_share,
    teleport_weights,
)
from .plans.metrics import metrics_table, network_metrics, sort_metrics_file, sorted_metrics
from .schema import Graph, GraphError
from .sinks.metrics_text import (
    betweenness_metrics,
    rendered,
    static_rank_metrics,
    write_betweenness,
    write_metrics_parquet,
    write_metrics_text,
    write_static_rank,
)
from .sources.metrics_text import read_metrics
from .sources.pajek import read_pajek, write_pajek
from .sources.tables import (
    check_endpoints,
    endpoints,
    graph_from_edges,
    links_last_wins,
    missing_endpoints,
    stored,
)

__all__ = [name for name in dir() if not name.startswith("_")]
