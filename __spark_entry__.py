"""

Graphs come from the given tables:

trade      customers to suppliers by ordered quantity (orders, lineitem)
accounts   the same links over all customers and suppliers, weighted by balance
users      from each event's user to the next event's user (events)
places     customers, nations and regions, linked both ways (customer, nation)
nations    customer nation to supplier nation by ordered quantity
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import linkgauge as lg
from linkgauge.functions.columns import SEP_RE
from linkgauge.plans.loop import checkpoint_folder, store
from linkgauge.schema import METRICS, Graph
from linkgauge.sinks.metrics_text import SEP_SPACED, SEP_TIGHT

try:
    from linkgauge.llm import queries as llm_queries
except ImportError as error:  # the subpackage is left out; a fault inside it is no reason to go on
    if error.name not in ("linkgauge.llm", "linkgauge.llm.queries"):
        raise
    llm_queries = None
try:
    import corpus_pipeline
except ImportError as error:
    if error.name not in ("corpus_pipeline", "linkgauge.llm"):
        raise
    corpus_pipeline = None

STATIC_ROUNDS = 15
PIVOTS = 64
DELTA_TOL = 1.0e-8
DIGITS = 8
# Ranks are compared by significant digits, nine of them.
RANKS, SIGNIFICANT = ("page_rank", "page_rank_normalized", "teleport_flow"), "%.8e"


def entry(spark: SparkSession) -> DataFrame:
    """Suppliers and customers of the trade graph by PageRank."""
    graph = _trade(spark, "/root/testdata/sf0.001")
    rank = lg.normalized(_rank(graph), graph)
    return rank.select("id", "page_rank", "page_rank_normalized").orderBy(F.desc("page_rank"), "id")


# ---------------------------------------------------------------- graphs


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tagged(tag: str, key: str):
    return F.concat(F.lit(tag), F.col(key).cast("string"))


def _trade_links(spark: SparkSession, sf: str) -> DataFrame:
    orders, items = _table(spark, sf, "orders"), _table(spark, sf, "lineitem")
    return (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .groupBy(_tagged("c", "o_custkey").alias("src"), _tagged("s", "l_suppkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("weight"))
    )


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    customers = _table(spark, sf, "customer").select(_tagged("c", "c_custkey").alias("id"), "c_name", "c_acctbal")
    suppliers = _table(spark, sf, "supplier").select(_tagged("s", "s_suppkey").alias("id"), "s_name", "s_acctbal")
    return customers.union(suppliers)


def _trade(spark: SparkSession, sf: str) -> Graph:
    return lg.stored(lg.graph_from_edges(_trade_links(spark, sf), weight="weight", distinct=True))


def _account_graph(spark: SparkSession, sf: str) -> Graph:
    links = lg.graph_from_edges(
        _trade_links(spark, sf), weight="weight",
        vertices=_accounts(spark, sf), name="c_name", node_weight="c_acctbal", distinct=True,
    )
    return lg.stored(links)


def _account_nodes(spark: SparkSession, sf: str) -> Graph:
    """The accounts alone, for what doesn't depend on links."""
    none = spark.createDataFrame([], "src string, dst string")
    return lg.graph_from_edges(
        none, vertices=_accounts(spark, sf), name="c_name", node_weight="c_acctbal", distinct=True
    )


def _user_links(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select("ts", "event_id", "user_id", "value")
    placed = lg.with_position(events, [F.col("ts"), F.col("event_id")], "pos")
    this = placed.select((F.col("pos") + 1).alias("pos"), _tagged("u", "user_id").alias("src"))
    following = placed.select("pos", _tagged("u", "user_id").alias("dst"), F.col("value").alias("weight"))
    return this.join(following, "pos")


def _users(spark: SparkSession, sf: str) -> Graph:
    return lg.stored(lg.graph_from_edges(_user_links(spark, sf), weight="weight", order="pos"))


def _places(spark: SparkSession, sf: str) -> Graph:
    customers, nations = _table(spark, sf, "customer"), _table(spark, sf, "nation")
    lower = customers.select(_tagged("c", "c_custkey").alias("src"), _tagged("n", "c_nationkey").alias("dst"))
    upper = nations.select(_tagged("n", "n_nationkey").alias("src"), _tagged("r", "n_regionkey").alias("dst"))
    upward = lower.union(upper)
    return lg.stored(lg.graph_from_edges(upward.union(upward.select("dst", "src")), distinct=True))


def _nations(spark: SparkSession, sf: str) -> Graph:
    orders, items = _table(spark, sf, "orders"), _table(spark, sf, "lineitem")
    customers, suppliers = _table(spark, sf, "customer"), _table(spark, sf, "supplier")
    links = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
        .groupBy(_tagged("n", "c_nationkey").alias("src"), _tagged("n", "s_nationkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("weight"))
    )
    names = _table(spark, sf, "nation").select(_tagged("n", "n_nationkey").alias("id"), "n_name")
    return lg.stored(lg.graph_from_edges(links, weight="weight", vertices=names, name="n_name", distinct=True))


def _last_users(spark: SparkSession, sf: str) -> DataFrame:
    """The users of the last event of each type."""
    last = _table(spark, sf, "events").groupBy("event_type").agg(F.max_by("user_id", "event_id").alias("user_id"))
    return last.select(_tagged("u", "user_id").alias("id")).distinct()


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "region").select(_tagged("r", "r_regionkey").alias("id"))


# --------------------------------------------------------------- queries


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    def rounded(column: str):
        if column in RANKS:
            return F.format_string(SIGNIFICANT, F.col(column)).cast("double")
        return F.round(F.col(column), DIGITS)

    return frame.withColumns({c: rounded(c) for c in columns})


def _rank(graph: Graph, teleport: str = "total_weight") -> DataFrame:
    return lg.pagerank(graph, teleport=teleport)


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/text-{uuid.uuid4().hex}"


def _link_counts(spark: SparkSession, sf: str) -> DataFrame:
    links = _user_links(spark, sf)
    graph = lg.stored(lg.graph_from_edges(links, weight="weight", order="pos"))
    counts = graph.header.select("num_node", "num_link", "total_node_weight")
    distinct = graph.edges.agg(F.count(F.lit(1)).alias("distinct_link"))
    return counts.withColumn("distinct_link", F.lit(distinct.first()["distinct_link"]))


def _endpoint_integrity(spark: SparkSession, sf: str) -> DataFrame:
    in_credit = _accounts(spark, sf).where(F.col("c_acctbal") > 0).select("id")
    return lg.missing_endpoints(in_credit, _trade_links(spark, sf))


def _in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return lg.in_degree(_accounts(spark, sf), _trade_links(spark, sf))


def _out_degree(spark: SparkSession, sf: str) -> DataFrame:
    return lg.out_degree(_accounts(spark, sf), _trade_links(spark, sf))


def _dangling_mass(spark: SparkSession, sf: str) -> DataFrame:
    graph = _account_graph(spark, sf)
    held = lg.teleport_weights(graph).withColumnRenamed("teleport", "page_rank")
    return _rounded(lg.dangling_mass(graph.vertices, graph.edges, held), "dangling_mass")


def _teleport_flow_sorted(spark: SparkSession, sf: str) -> DataFrame:
    rank = _rank(_account_graph(spark, sf))
    return _rounded(lg.sorted_metrics(rank, "teleport_flow"), "page_rank", "teleport_flow")


def _user_metrics(graph: Graph) -> DataFrame:
    return store(lg.metrics_table(graph, rank=_rank(graph)))


def _rounded_metrics(metrics: DataFrame) -> DataFrame:
    return _rounded(metrics, "page_rank", "page_rank_normalized", "betweenness")


def _fields(lines: DataFrame) -> DataFrame:
    """Rendered rows taken apart again, as strings would be by any other reader."""
    fields = F.split("value", SEP_RE)
    return lines.select(
        *[F.trim(F.get(fields, F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(METRICS)]
    )


def _metrics_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(_fields(lg.rendered(_user_metrics(_users(spark, sf)), SEP_SPACED)))


def _static_rendered(spark: SparkSession, sf: str) -> DataFrame:
    graph = _users(spark, sf)
    scores = lg.pagerank_static(graph, STATIC_ROUNDS).vertices
    return _rounded_metrics(_fields(lg.rendered(lg.static_rank_metrics(scores, graph), SEP_TIGHT)))


def _static_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks keyed by number for a graph keyed by text, written with the nodes' own betweenness."""
    links = _nations(spark, sf).edges.select(F.substring("src", 2, 9).alias("src"), F.substring("dst", 2, 9).alias("dst"))
    graph = lg.stored(lg.graph_from_edges(links, distinct=True))
    ranks = lg.pagerank_static(graph, STATIC_ROUNDS).vertices.withColumn("id", F.col("id").cast("long"))
    scores = lg.betweenness(graph).withColumn("id", F.col("id").cast("long"))
    folder = _scratch(spark)
    return _rounded_metrics(lg.read_metrics(spark, lg.write_static_rank(ranks, graph, folder, "nations", scores)))


def _metrics_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    lg.write_metrics_parquet(_user_metrics(_users(spark, sf)), path)
    return _rounded_metrics(spark.read.parquet(path))


def _network_metrics_file(spark: SparkSession, sf: str) -> DataFrame:
    given, out = _scratch(spark), _scratch(spark)
    lg.write_pajek(_users(spark, sf), given)
    lg.network_metrics(spark, given, out, with_betweenness=True)
    return _rounded_metrics(lg.read_metrics(spark, out))


def _betweenness_rendered(spark: SparkSession, sf: str) -> DataFrame:
    graph = _places(spark, sf)
    return _rounded_metrics(_fields(lg.rendered(lg.betweenness_metrics(lg.betweenness(graph), graph), SEP_TIGHT)))


def _metrics_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    lg.write_metrics_text(_user_metrics(_users(spark, sf)), path)
    return _rounded_metrics(lg.read_metrics(spark, path))


def _metrics_sorted_file(spark: SparkSession, sf: str) -> DataFrame:
    given, ordered = _scratch(spark), _scratch(spark)
    graph = _places(spark, sf)
    scores = lg.betweenness(graph)
    lg.write_metrics_text(lg.betweenness_metrics(scores, graph), given, SEP_TIGHT)
    lg.sort_metrics_file(spark, given, ordered, "betweenness", SEP_TIGHT)
    return _rounded_metrics(lg.read_metrics(spark, ordered))


def _pajek_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    lg.write_pajek(_account_graph(spark, sf), path)
    graph = lg.read_pajek(spark, path)
    nodes = graph.vertices.select(
        "id", F.lit(None).cast("string").alias("dst"), "name", F.col("node_weight").alias("weight")
    )
    links = graph.edges.select(F.col("src").alias("id"), "dst", F.lit(None).cast("string").alias("name"), "weight")
    return nodes.union(links)


def _pajek_header(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    lg.write_pajek(_nations(spark, sf), path)
    return lg.read_pajek(spark, path).header


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = llm_queries.queries() if llm_queries else {}
    return found | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def _llm_sql() -> dict[str, str]:
    return llm_queries.oracle_sql() if llm_queries else {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | _llm_queries()


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def share(of):
        return lambda spark, sf: _rounded(of(store(_trade_links(spark, sf))), "share")

    def teleport(rule):
        return lambda spark, sf: _rounded(lg.teleport_weights(_account_nodes(spark, sf), rule), "teleport")

    def account_rank(rule):
        return lambda spark, sf: _rounded(
            _rank(_account_graph(spark, sf), rule).select("id", "page_rank"), "page_rank"
        )

    def normalized_rank(spark, sf):
        graph = _trade(spark, sf)
        rank = lg.normalized(_rank(graph).select("id", "page_rank"), graph)
        return _rounded(rank, "page_rank", "page_rank_normalized")

    def accounts_dangling(spark, sf):
        return lg.dangling_nodes(_accounts(spark, sf), _trade_links(spark, sf))

    return {
        "graph_edges_last_wins": lambda spark, sf: _users(spark, sf).edges,
        "link_count_vs_distinct": _link_counts,
        "endpoint_integrity": _endpoint_integrity,
        "in_degree": _in_degree,
        "out_degree": _out_degree,
        "average_degree": lambda spark, sf: _rounded(lg.average_degree(_trade(spark, sf)), "average_degree"),
        "out_weight_share": share(lg.out_weight_share),
        "out_degree_share": share(lg.out_degree_share),
        "teleport_total": teleport("total_weight"),
        "teleport_count": teleport("count"),
        "dangling_nodes": accounts_dangling,
        "dangling_mass": _dangling_mass,
        "pagerank_power": lambda spark, sf: _rounded(
            lg.pagerank(_users(spark, sf)).select("id", "page_rank"), "page_rank"
        ),
        "pagerank_node_weighted": account_rank("total_weight"),
        "pagerank_count_teleport": account_rank("count"),
        "pagerank_normalized": normalized_rank,
        "pagerank_static": lambda spark, sf: _rounded(
            lg.pagerank_static(_users(spark, sf), STATIC_ROUNDS).vertices, "page_rank"
        ),
        "pagerank_static_from_one": lambda spark, sf: _rounded(
            lg.pagerank_static(_users(spark, sf), STATIC_ROUNDS, initial_rank=1.0).vertices, "page_rank"
        ),
        "pagerank_delta": lambda spark, sf: _rounded(
            lg.pagerank_delta(_users(spark, sf), DELTA_TOL).vertices, "page_rank"
        ),
        "teleport_flow_sorted": _teleport_flow_sorted,
        "bfs_levels": lambda spark, sf: lg.shortest_paths(
            _places(spark, sf), _regions(spark, sf)
        ).select("source", "id", "dist"),
        "path_counts": lambda spark, sf: lg.shortest_paths(_users(spark, sf), _last_users(spark, sf)),
        "touched_nodes": lambda spark, sf: spark.range(1).select(
            F.lit(lg.touched_nodes(_places(spark, sf))).cast("long").alias("touched")
        ),
        "betweenness": lambda spark, sf: _rounded(lg.betweenness(_users(spark, sf)), "betweenness"),
        "betweenness_sources": lambda spark, sf: _rounded(
            lg.betweenness(_users(spark, sf), _last_users(spark, sf)), "betweenness"
        ),
        "betweenness_places": lambda spark, sf: _rounded(lg.betweenness(_places(spark, sf)), "betweenness"),
        "betweenness_estimate": lambda spark, sf: _rounded(
            lg.betweenness_estimate(_users(spark, sf), pivots=PIVOTS), "betweenness", "error"
        ),
        "metrics_table": lambda spark, sf: _rounded_metrics(_user_metrics(_users(spark, sf))),
        "rank_positions": lambda spark, sf: lg.rank_positions(
            _rounded_metrics(_user_metrics(_users(spark, sf)))
        ),
        "metrics_sorted": lambda spark, sf: lg.sorted_metrics(_rounded_metrics(_user_metrics(_users(spark, sf)))),
        "metrics_rendered": _metrics_rendered,
        "metrics_parquet": _metrics_parquet,
        "network_metrics_file": _network_metrics_file,
        "static_rank_rendered": _static_rendered,
        "static_rank_scored": _static_scored,
        "betweenness_rendered": _betweenness_rendered,
        "metrics_round_trip": _metrics_round_trip,
        "metrics_sorted_file": _metrics_sorted_file,
        "pajek_round_trip": _pajek_round_trip,
        "pajek_header": _pajek_header,
    }


# ------------------------------------------------------------ oracle SQL

# Shortest paths are unrolled to this many levels; all graphs here are shallower.
LEVELS = 6

# Rounds by which every rank here has settled to the digits compared.
RANK_ROUNDS = 200

TRADE = """
links AS MATERIALIZED (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, SUM(l_quantity) AS weight
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""

ACCOUNTS = """
accounts AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, s_acctbal FROM supplier),
nodes AS MATERIALIZED (
  SELECT id, name, CASE WHEN balance > 0 AND NOT isnan(balance) THEN balance ELSE 1.0 END AS node_weight
  FROM accounts)"""

USERS = """
seq AS (SELECT user_id, value, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS pos FROM events),
raw AS MATERIALIZED (
  SELECT 'u' || a.user_id AS src, 'u' || b.user_id AS dst, b.pos,
         CASE WHEN b.value > 0 AND NOT isnan(b.value) THEN b.value ELSE 1.0 END AS weight
  FROM seq a JOIN seq b ON b.pos = a.pos + 1),
links AS MATERIALIZED (SELECT src, dst, arg_max(weight, pos) AS weight FROM raw GROUP BY 1, 2)"""

PLACES = """
upward AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
links AS MATERIALIZED (
  SELECT src, dst, 1.0 AS weight FROM upward UNION ALL SELECT dst, src, 1.0 FROM upward)"""

ENDPOINTS = """
nodes AS MATERIALIZED (
  SELECT id, id AS name, 1.0 AS node_weight FROM (SELECT src AS id FROM links UNION SELECT dst FROM links))"""


def _power_sql(teleport: str, rounds: int) -> str:
    """CTEs after links and nodes: final (id, page_rank, teleport_flow)."""
    divisor = "SUM(node_weight)" if teleport == "total_weight" else "COUNT(*)"
    return f"""
outs AS (SELECT src, SUM(weight) AS total FROM links GROUP BY src),
shares AS MATERIALIZED (SELECT l.src, l.dst, l.weight / o.total AS p FROM links l JOIN outs o ON o.src = l.src),
base AS MATERIALIZED (
  SELECT n.id, n.node_weight / (SELECT {divisor} FROM nodes) AS t, o.src IS NULL AS dangling
  FROM nodes n LEFT JOIN outs o ON o.src = n.id),
ranks(k, id, x) AS (
  SELECT 0, id, 1.0::DOUBLE / (SELECT COUNT(*) FROM base) FROM base
  UNION ALL
  SELECT k, id, y / SUM(y) OVER () FROM (
    SELECT d.k + 1 AS k, b.id, (0.15 + 0.85 * d.mass) * b.t + 0.85 * COALESCE(f.flow, 0) AS y
    FROM base b
    CROSS JOIN (SELECT MAX(r.k) AS k, COALESCE(SUM(CASE WHEN g.dangling THEN r.x END), 0) AS mass
                FROM ranks r JOIN base g ON g.id = r.id) d
    LEFT JOIN (SELECT s.dst AS id, SUM(s.p * r.x) AS flow
               FROM shares s JOIN ranks r ON r.id = s.src GROUP BY s.dst) f ON f.id = b.id
    WHERE d.k < {rounds})),
last_ranks AS MATERIALIZED (SELECT id, x FROM ranks WHERE k = {rounds}),
held AS (SELECT COALESCE(SUM(CASE WHEN g.dangling THEN r.x END), 0) AS mass
         FROM last_ranks r JOIN base g ON g.id = r.id),
final AS (
  SELECT b.id, r.x AS page_rank, (0.15 + 0.85 * held.mass) * b.t AS teleport_flow
  FROM base b JOIN last_ranks r ON r.id = b.id CROSS JOIN held)"""


STATIC_SQL = f"""
degs AS (SELECT src, COUNT(*) AS deg FROM links GROUP BY src),
shares AS MATERIALIZED (SELECT l.src, l.dst, 1.0::DOUBLE / d.deg AS p FROM links l JOIN degs d ON d.src = l.src),
ranks(k, id, x) AS (
  SELECT 0, id, 0.15::DOUBLE FROM nodes
  UNION ALL
  SELECT d.k + 1, n.id, 0.15 + 0.85 * COALESCE(f.flow, 0)
  FROM nodes n
  CROSS JOIN (SELECT MAX(k) AS k FROM ranks) d
  LEFT JOIN (SELECT s.dst AS id, SUM(s.p * r.x) AS flow
             FROM shares s JOIN ranks r ON r.id = s.src GROUP BY s.dst) f ON f.id = n.id
  WHERE d.k < {STATIC_ROUNDS}),
final AS (SELECT id, x AS page_rank FROM ranks WHERE k = {STATIC_ROUNDS})"""

DELTA_SQL = f"""
degs AS (SELECT src, COUNT(*) AS deg FROM links GROUP BY src),
shares AS MATERIALIZED (SELECT l.src, l.dst, 1.0::DOUBLE / d.deg AS p FROM links l JOIN degs d ON d.src = l.src),
ranks(k, id, x, delta) AS (
  SELECT 0, id, 0.15::DOUBLE, 0.15::DOUBLE FROM nodes
  UNION ALL
  SELECT o.k + 1, o.id, o.x + 0.85 * COALESCE(f.flow, 0), 0.85 * COALESCE(f.flow, 0)
  FROM ranks o
  LEFT JOIN (SELECT s.dst AS id, SUM(s.p * r.delta) AS flow
             FROM shares s JOIN ranks r ON r.id = s.src WHERE r.delta > {DELTA_TOL} GROUP BY s.dst) f ON f.id = o.id
  WHERE (SELECT MAX(r.delta) FROM ranks r JOIN degs g ON g.src = r.id) > {DELTA_TOL}),
final AS (SELECT id, x AS page_rank FROM ranks WHERE k = (SELECT MAX(k) FROM ranks))"""


def _paths_sql() -> str:
    """CTEs level_0 .. level_N (source, id, sigma) and paths (source, id, dist, sigma)."""
    parts = ["level_0 AS MATERIALIZED (SELECT id AS source, id, 1.0::DOUBLE AS sigma FROM nodes)"]
    for k in range(1, LEVELS + 1):
        visited = " UNION ALL ".join(f"SELECT source, id FROM level_{j}" for j in range(k))
        parts.append(f"""level_{k} AS MATERIALIZED (
  SELECT f.source, f.id, f.sigma FROM (
    SELECT p.source, l.dst AS id, SUM(p.sigma) AS sigma
    FROM level_{k - 1} p JOIN links l ON l.src = p.id GROUP BY 1, 2) f
  WHERE NOT EXISTS (SELECT 1 FROM ({visited}) v WHERE v.source = f.source AND v.id = f.id))""")
    every = " UNION ALL ".join(f"SELECT source, id, {k} AS dist, sigma FROM level_{k}" for k in range(LEVELS + 1))
    return ",\n".join([*parts, f"paths AS ({every})"])


LAST_USERS = "(SELECT 'u' || arg_max(user_id, event_id) FROM events GROUP BY event_type)"

NATIONS = """
links AS MATERIALIZED (
  SELECT DISTINCT c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _betweenness_sql(sources: str = "") -> str:
    """CTEs after paths: scores (id, betweenness), of chosen sources if they are given."""
    chosen = f"WHERE source IN {sources}" if sources else ""
    parts = [f"back_{LEVELS} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS delta FROM level_{LEVELS})"]
    for k in range(LEVELS - 1, 0, -1):
        parts.append(f"""back_{k} AS MATERIALIZED (
  SELECT v.source, v.id, v.sigma, COALESCE(SUM(v.sigma / w.sigma * (1 + w.delta)), 0) AS delta
  FROM level_{k} v LEFT JOIN links l ON l.src = v.id
  LEFT JOIN back_{k + 1} w ON w.source = v.source AND w.id = l.dst
  GROUP BY 1, 2, 3)""")
    every = " UNION ALL ".join(f"SELECT id, delta FROM back_{k} {chosen}" for k in range(1, LEVELS + 1))
    return ",\n".join([*parts, f"""scores AS (
  SELECT n.id, COALESCE(SUM(b.delta), 0) AS betweenness FROM nodes n LEFT JOIN ({every}) b ON b.id = n.id GROUP BY 1)"""])


def _estimate_sql() -> str:
    """CTEs after paths: estimate (id, mean, error, n, k), means being shares of n - 2."""
    pivots = f"(SELECT id FROM nodes ORDER BY md5('0:' || id), id LIMIT {PIVOTS})"
    every = " UNION ALL ".join(f"SELECT id, delta FROM back_{k} WHERE source IN (SELECT id FROM pivots)" for k in range(1, LEVELS + 1))
    return ",\n".join([f"pivots AS MATERIALIZED {pivots}", _betweenness_sql(), f"""
sizes AS (SELECT COUNT(*) AS n, LEAST({PIVOTS}, COUNT(*)) AS k, LN(10 * COUNT(*) / 0.05::DOUBLE) AS log FROM nodes),
sampled AS (
  SELECT n.id, COALESCE(SUM(b.delta), 0) AS score, COALESCE(SUM(b.delta * b.delta), 0) AS square
  FROM nodes n LEFT JOIN ({every}) b ON b.id = n.id GROUP BY 1),
means AS (
  SELECT id, score / (k * (n - 2)) AS mean, square / (k * POWER(n - 2, 2)) AS square, n, k, log,
         CASE WHEN 2 * k <= n THEN 1 - (k - 1) / n ELSE (1 - k / n) * (1 + 1 / k) END AS unseen
  FROM sampled CROSS JOIN sizes),
estimate AS (
  SELECT id, mean, n, k, CASE WHEN k = n THEN 0 ELSE
    SQRT(GREATEST(square - mean * mean, 0)) * SQRT(2 * unseen * log / k) + (7 / 3 + 3 / SQRT(2)) * log / k END AS error
  FROM means)"""])


ESTIMATE_SQL = _estimate_sql()

METRICS_SQL = """
indegs AS (SELECT dst, COUNT(*) AS n FROM links GROUP BY dst),
metrics AS MATERIALIZED (
  SELECT n.id, COALESCE(i.n, 0) AS in_degree, printf('%.8e', f.page_rank)::DOUBLE AS page_rank,
         printf('%.8e', f.page_rank * (SELECT COUNT(*) FROM raw))::DOUBLE AS page_rank_normalized,
         ROUND(s.betweenness, 8) AS betweenness, n.name
  FROM nodes n JOIN final f ON f.id = n.id JOIN scores s ON s.id = n.id LEFT JOIN indegs i ON i.dst = n.id)"""


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then


def oracle_sql() -> dict[str, str]:
    return _own_sql() | _llm_sql()


def _own_sql() -> dict[str, str]:
    rank = "SELECT id, printf('%.8e', page_rank)::DOUBLE AS page_rank FROM final"
    accounts = (TRADE, ACCOUNTS)
    users = (USERS, ENDPOINTS)
    places = (PLACES, ENDPOINTS)
    paths = _paths_sql()
    between = (paths, _betweenness_sql())
    user_metrics = (*users, _power_sql("total_weight", RANK_ROUNDS), *between, METRICS_SQL)
    all_metrics = _with(*user_metrics, then="SELECT * FROM metrics")
    place_metrics = _with(*places, *between, then="""
SELECT n.id, COALESCE(i.n, 0) AS in_degree, 0.0::DOUBLE AS page_rank, 0.0::DOUBLE AS page_rank_normalized,
       ROUND(s.betweenness, 8) AS betweenness, n.name
FROM nodes n JOIN scores s ON s.id = n.id
LEFT JOIN (SELECT dst, COUNT(*) AS n FROM links GROUP BY dst) i ON i.dst = n.id""")

    def degree(end: str, name: str) -> str:
        return _with(*accounts, then=f"""
SELECT n.id, COALESCE(d.n, 0) AS {name} FROM nodes n
LEFT JOIN (SELECT {end} AS id, COUNT(*) AS n FROM links GROUP BY 1) d ON d.id = n.id""")

    def teleport(divisor: str) -> str:
        return _with(ACCOUNTS, then=f"""
SELECT id, ROUND(node_weight / (SELECT {divisor} FROM nodes), 8) AS teleport FROM nodes""")

    return {
        "graph_edges_last_wins": _with(USERS, then="SELECT src, dst, weight FROM links"),
        "link_count_vs_distinct": _with(*users, then="""
SELECT (SELECT COUNT(*) FROM nodes) AS num_node, (SELECT COUNT(*) FROM raw) AS num_link,
       (SELECT SUM(node_weight)::DOUBLE FROM nodes) AS total_node_weight,
       (SELECT COUNT(*) FROM links) AS distinct_link"""),
        "endpoint_integrity": _with(*accounts, then="""
SELECT e.id, COUNT(*) AS ends FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) e
WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.id = e.id AND a.balance > 0) GROUP BY e.id"""),
        "in_degree": degree("dst", "in_degree"),
        "out_degree": degree("src", "out_degree"),
        "average_degree": _with(TRADE, ENDPOINTS, then="""
SELECT (SELECT COUNT(*) FROM nodes) AS num_node, (SELECT COUNT(*) FROM links) AS num_edge,
       ROUND((SELECT COUNT(*) FROM links)::DOUBLE / (SELECT COUNT(*) FROM nodes), 8) AS average_degree"""),
        "out_weight_share": _with(TRADE, then="""
SELECT src, dst, ROUND(weight / SUM(weight) OVER (PARTITION BY src), 8) AS share FROM links"""),
        "out_degree_share": _with(TRADE, then="""
SELECT src, dst, ROUND(1.0::DOUBLE / COUNT(*) OVER (PARTITION BY src), 8) AS share FROM links"""),
        "teleport_total": teleport("SUM(node_weight)"),
        "teleport_count": teleport("COUNT(*)"),
        "dangling_nodes": _with(*accounts, then="""
SELECT id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = n.id)"""),
        "dangling_mass": _with(*accounts, then="""
SELECT COUNT(*) AS dangling_count,
       ROUND(COALESCE(SUM(node_weight), 0) / (SELECT SUM(node_weight) FROM nodes), 8) AS dangling_mass
FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = n.id)"""),
        "pagerank_power": _with(*users, _power_sql("total_weight", RANK_ROUNDS), then=rank),
        "pagerank_node_weighted": _with(*accounts, _power_sql("total_weight", RANK_ROUNDS), then=rank),
        "pagerank_count_teleport": _with(*accounts, _power_sql("count", RANK_ROUNDS), then=rank),
        "pagerank_normalized": _with(TRADE, ENDPOINTS, _power_sql("total_weight", RANK_ROUNDS), then="""
SELECT id, printf('%.8e', page_rank)::DOUBLE AS page_rank,
       printf('%.8e', page_rank * (SELECT COUNT(*) FROM links))::DOUBLE AS page_rank_normalized FROM final"""),
        "pagerank_static": _with(*users, STATIC_SQL, then=rank),
        "pagerank_static_from_one": _with(
            *users, STATIC_SQL.replace("SELECT 0, id, 0.15::DOUBLE", "SELECT 0, id, 1.0::DOUBLE"), then=rank
        ),
        "pagerank_delta": _with(*users, DELTA_SQL, then=rank),
        "teleport_flow_sorted": _with(*accounts, _power_sql("total_weight", RANK_ROUNDS), then="""
SELECT id, printf('%.8e', page_rank)::DOUBLE AS page_rank, printf('%.8e', teleport_flow)::DOUBLE AS teleport_flow FROM final"""),
        "bfs_levels": _with(*places, paths, then="""
SELECT source, id, dist FROM paths WHERE source IN (SELECT 'r' || r_regionkey FROM region)"""),
        "path_counts": _with(*users, paths, then=f"""
SELECT source, id, dist, sigma FROM paths WHERE source IN {LAST_USERS}"""),
        "touched_nodes": _with(*places, paths, then="SELECT COUNT(*) AS touched FROM paths"),
        "betweenness": _with(*users, *between, then="SELECT id, ROUND(betweenness, 8) AS betweenness FROM scores"),
        "betweenness_sources": _with(
            *users, paths, _betweenness_sql(LAST_USERS), then="SELECT id, ROUND(betweenness, 8) AS betweenness FROM scores"
        ),
        "betweenness_places": _with(
            *places, *between, then="SELECT id, ROUND(betweenness, 8) AS betweenness FROM scores"
        ),
        "betweenness_estimate": _with(*users, paths, ESTIMATE_SQL, then="""
SELECT id, ROUND(mean * n * (n - 2), 8) AS betweenness, ROUND(error * n * (n - 2), 8) AS error, k AS pivots FROM estimate"""),
        "metrics_table": all_metrics,
        "rank_positions": _with(*user_metrics, then="""
SELECT *, ROW_NUMBER() OVER (ORDER BY in_degree DESC, id) AS cite_count_rank,
       ROW_NUMBER() OVER (ORDER BY page_rank DESC, id) AS page_rank_rank,
       ROW_NUMBER() OVER (ORDER BY betweenness DESC, id) AS betweenness_rank FROM metrics"""),
        "metrics_sorted": all_metrics,
        "metrics_rendered": all_metrics,
        "metrics_parquet": all_metrics,
        "network_metrics_file": all_metrics.replace("(SELECT COUNT(*) FROM raw)", "(SELECT COUNT(*) FROM links)"),
        "static_rank_rendered": _with(*users, STATIC_SQL, then="""
SELECT n.id, COALESCE(i.n, 0) AS in_degree, printf('%.8e', f.page_rank / (SELECT COUNT(*) FROM raw))::DOUBLE AS page_rank,
       printf('%.8e', f.page_rank)::DOUBLE AS page_rank_normalized, 0.0::DOUBLE AS betweenness, n.name
FROM nodes n JOIN final f ON f.id = n.id
LEFT JOIN (SELECT dst, COUNT(*) AS n FROM links GROUP BY dst) i ON i.dst = n.id"""),
        "static_rank_scored": _with(NATIONS, ENDPOINTS, STATIC_SQL, *between, then="""
SELECT n.id, COALESCE(i.n, 0) AS in_degree, printf('%.8e', f.page_rank / (SELECT COUNT(*) FROM links))::DOUBLE AS page_rank,
       printf('%.8e', f.page_rank)::DOUBLE AS page_rank_normalized, ROUND(s.betweenness, 8) AS betweenness, n.name
FROM nodes n JOIN final f ON f.id = n.id JOIN scores s ON s.id = n.id
LEFT JOIN (SELECT dst, COUNT(*) AS n FROM links GROUP BY dst) i ON i.dst = n.id"""),
        "betweenness_rendered": place_metrics,
        "metrics_round_trip": all_metrics,
        "metrics_sorted_file": place_metrics,
        "pajek_round_trip": _with(*accounts, then="""
SELECT id, NULL::VARCHAR AS dst, name, node_weight AS weight FROM nodes
UNION ALL SELECT src, dst, NULL, weight FROM links"""),
        "pajek_header": """
WITH links AS (
  SELECT DISTINCT c_nationkey, s_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT (SELECT COUNT(*) FROM nation) AS num_node, (SELECT COUNT(*) FROM links) AS num_link,
       (SELECT COUNT(*) FROM nation) AS node_lines, (SELECT COUNT(*) FROM links) AS link_lines,
       (SELECT COUNT(*) FROM nation)::DOUBLE AS total_node_weight""",
    }
