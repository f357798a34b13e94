"""PageRank in three forms, each a loop of one join, one aggregation and one
checkpoint per round, with only a few scalars on the driver.

All sums are exact (see ``functions.exact``), so ranks are the same to the last bit on every
run, whatever the partitions, and so is the round in which a stop rule holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..plans.ledger import Ledger
from ..plans.loop import checkpoint, discard, fixed_layout, hashed, partitions_for, store
from ..schema import Graph, GraphError
from ..sources.tables import checked
from .layout import LinksBySource, links_by_source
from .weights import out_degree_share, teleport_divisor

# The default stop rule, the restart probability, and the step by
# which the latter grows when two rounds in a row change by exactly as much.
ALPHA = 0.15
MAX_ITER = 200
MIN_ITER = 50
TOL = 1.0e-15
ALPHA_STEP = 1.0e-10

# What the ranks of the power method sum to at most; they sum to 1 but for rounding.
RANKS = 2.0

# Rounds of the power method after which a job with a name writes its ranks to its ledger.
SAVED = 10

# Links of a partition at most. A round shuffles up to one row for each target and partition of links, so few
# partitions shuffle least; there are more only to give every core of the cluster work of at least LEAST_LINKS.
MOST_LINKS, LEAST_LINKS = 4_000_000, 25_000

# Rounds of gains after which they are added to the ranks.
FOLD = 16

# The first round has no earlier change to compare with; by teleport rule.
INITIAL_CHANGE = {"total_weight": 1.0, "count": 0.0}


@dataclass(frozen=True)
class RankedGraph:
    """vertices: id, page_rank. edges: src, dst, share (one over the out-degree), which
    is worked out when it is asked for."""

    vertices: DataFrame
    links: DataFrame

    @property
    def edges(self) -> DataFrame:
        return out_degree_share(self.links)


class _Start(NamedTuple):
    state: DataFrame
    links: LinksBySource
    totals: dict


def pagerank(
    graph: Graph,
    alpha: float = ALPHA,
    teleport: str = "total_weight",
    max_iter: int = MAX_ITER,
    min_iter: int = MIN_ITER,
    tol: float = TOL,
    partitions: int | None = None,
    job: str | None = None,
) -> DataFrame:
    """Power method with node and link weights and dangling nodes; sums to 1.

    With t the teleport weights and p the links' shares of their source's weight,
    each round sends ``(alpha + beta * dangling rank) * t`` to every node and
    ``beta * p * rank`` along every link, then divides by the sum. It runs at least
    ``min_iter`` and at most ``max_iter`` rounds, and in between until the ranks
    change by no more than ``tol`` in total.

    A node without incoming links has its teleport part alone, a factor of the round times its weight. So such nodes take no
    part in the rounds: what they send is summed up once and scaled by that factor.

    ``job`` names a run: every ``SAVED`` rounds its ranks go to a ledger, and if its driver is lost, another one given the
    same name, graph and settings goes on from there, to the same bits.

    Returns id, page_rank and teleport_flow, the next round's teleport part.
    """
    graph = checked(graph)
    divisor = teleport_divisor(graph, teleport)
    header = graph.header.first()
    if not header["num_node"]:
        return _empty(graph, "page_rank", "teleport_flow")
    partitions = partitions or _partitions(graph)
    with _started(graph, ["src", "dst", "weight"], header["num_node"], partitions) as start:
        nodes = start.totals["nodes"]
        teleport_sum = start.totals["node_weight"] / divisor
        initial = 1.0 / nodes
        first, inner, outer, links = start.state, start.state, None, start.links
        if start.totals["outer"]:
            outer = start.state.where("NOT entered").select("id", "node_weight")
            inner, links = _without_outer(start, initial, partitions)
        inner = inner.drop("entered")
        carried = [c for c in inner.columns if c != "given_first"]
        state = inner.withColumn("rank", F.lit(initial))
        # the factor of the nodes outside the rounds, after the first of these
        scale = None
        mass, dangling = 1.0, (nodes - start.totals["senders"]) / nodes
        previous_change = INITIAL_CHANGE[teleport]
        written, done = None, 0
        ledger = Ledger(graph.vertices.sparkSession, job)
        ledger.belongs_to(nodes=graph.vertices.select("id", "node_weight"), links=graph.edges.select("src", "dst", "weight"))
        settings = [alpha, teleport, max_iter, min_iter, tol, "outer nodes apart"]
        if job and ledger.note("settings", lambda: settings) != settings:
            raise ValueError(f"{ledger.folder} holds a job with other settings")
        saved = [e for name, e in ledger.entries().items() if name.startswith("round-")] if job else []
        if saved:
            last = max(saved, key=lambda e: e["value"]["done"])
            ranks = hashed(ledger.spark.read.parquet(last["path"]), nodes, partitions)
            written = state = checkpoint(inner.select(*carried).join(ranks, "id"))
            done, alpha, mass, dangling, previous_change, scale = (
                last["value"][k] for k in ("done", "alpha", "mass", "dangling", "change", "scale")
            )
            if done >= min_iter and previous_change <= tol:
                max_iter = done
        for iteration in range(done + 1, max_iter + 1):
            beta = 1.0 - alpha
            teleported = alpha + beta * dangling
            # What the new ranks will sum to before division, known from the old.
            total = teleported * teleport_sum + beta * (mass - dangling)
            received, arrived = state, "0D"
            if links is not None:
                inflow = links.inflow(_shares(state, "rank / out_weight"), "weight * share", RANKS)
                received, arrived = state.join(hashed(inflow, nodes, partitions), "id", "left"), "coalesce(inflow, 0D)"
            if outer is not None:
                arrived += " + given_first" if scale is None else f" + {_double(scale)} * given"
            step, factor = _double(beta / total), teleported / divisor / total
            state, seen = _next_round(
                received.selectExpr(
                    *carried, "rank AS before", f"{_double(factor)} * node_weight + {step} * ({arrived}) AS rank",
                ),
                mass=_sum_or_zero("rank", RANKS),
                dangling=_sum_or_zero("if(out_degree = 0, rank, 0D)", RANKS),
                change=_sum_or_zero("abs(rank - before)", 2 * RANKS),
                passing=["before"],
            )
            discard(written)
            written = state
            mass, dangling, change = seen["mass"], seen["dangling"], seen["change"]
            if outer is not None:
                mass += factor * start.totals["outer_weight"]
                dangling += factor * start.totals["outer_dangling"]
                if scale is None:
                    moved = f"abs({_double(factor)} * node_weight - {_double(initial)})"
                    change += outer.agg(F.expr(f"{_sum_or_zero(moved, 2 * RANKS)} AS moved")).first()["moved"]
                else:
                    change += abs(factor - scale) * start.totals["outer_weight"]
                scale = factor
            if abs(mass - 1.0) > 1.0e-6:
                raise GraphError(f"ranks sum to {mass}: the graph changed meanwhile")
            if change == previous_change:
                alpha += ALPHA_STEP
            previous_change = change
            if job and iteration % SAVED == 0:
                with ledger.step(f"round-{iteration}") as attempt:
                    attempt.add(state.select("id", "rank"))
                    attempt.value = {
                        "done": iteration, "alpha": alpha, "mass": mass, "dangling": dangling, "change": change, "scale": scale,
                    }
            if iteration >= min_iter and change <= tol:
                break
        if outer is None:
            discard(first)
        else:
            if links is not None:
                links.release()
            alone = _double(initial) if scale is None else f"{_double(scale)} * node_weight"
            state = state.select("id", "node_weight", "rank").union(outer.selectExpr("id", "node_weight", f"{alone} AS rank"))
    flow = F.lit((alpha + (1.0 - alpha) * dangling) / divisor) * F.col("node_weight")
    return state.select("id", F.col("rank").alias("page_rank"), flow.alias("teleport_flow"))


def _without_outer(start: _Start, initial: float, partitions: int) -> tuple[DataFrame, LinksBySource | None]:
    """The nodes that links lead to, and the links between them if there are any. ``given`` is what a node receives from outer nodes, those
    without incoming links, if their ranks are their weights; ``given_first`` if all ranks are ``initial``."""
    nodes = start.totals["nodes"]
    senders = start.state.where("NOT entered AND out_degree > 0")
    shares = senders.selectExpr("id AS src", "out_degree", "node_weight / out_weight AS share", f"{_double(initial)} / out_weight AS even")
    given = store(start.links.inflows(
        shares, given=("weight * share", start.totals["outer_weight"]), given_first=("weight * even", RANKS)
    ))
    inner = start.state.where("entered").join(hashed(given, nodes, partitions), "id", "left")
    inner = checkpoint(inner.na.fill(0.0, ["given", "given_first"]))
    if start.totals["senders"] == start.totals["outer_senders"]:
        return inner, None
    links = start.links.of(inner.selectExpr("id AS src", "out_degree").where("out_degree > 0"))
    return inner, links


def normalized(rank: DataFrame, graph: Graph) -> DataFrame:
    """Add page_rank_normalized: the rank times the graph's link count."""
    links = graph.header.first()["num_link"]
    return rank.withColumn("page_rank_normalized", F.col("page_rank") * F.lit(float(links)))


def pagerank_static(
    graph: Graph,
    num_iter: int,
    reset_prob: float = ALPHA,
    initial_rank: float | None = None,
    partitions: int | None = None,
) -> RankedGraph:
    """A fixed number of rounds of ``reset_prob + (1 - reset_prob) * sum of ranks over
    out-degrees``, unnormalised: a node without incoming links has ``reset_prob``.

    Link weights are ignored. ``initial_rank`` defaults to ``reset_prob``.
    """
    graph = checked(graph)
    header = graph.header.first()
    if not header["num_node"]:
        return RankedGraph(_empty(graph, "page_rank"), graph.edges)
    initial = reset_prob if initial_rank is None else initial_rank
    partitions = partitions or _partitions(graph)
    with _started(graph, ["src", "dst"], header["num_node"], partitions) as start:
        state = start.state.selectExpr("id", "out_degree", f"{_double(initial)} AS rank")
        reset, step = _double(reset_prob), _double(1.0 - reset_prob)
        most = _most(start.totals["nodes"], reset_prob, initial)
        written = start.state
        for _ in range(num_iter):
            inflow = start.links.inflow(_shares(state, "rank / out_degree"), "share", most)
            received = state.join(hashed(inflow, start.totals["nodes"], partitions), "id", "left")
            state = checkpoint(received.selectExpr("id", "out_degree", f"{reset} + {step} * coalesce(inflow, 0D) AS rank"))
            discard(written)
            written = state
    return RankedGraph(state.select("id", F.col("rank").alias("page_rank")), graph.edges)


def pagerank_delta(
    graph: Graph, tol: float, reset_prob: float = ALPHA, partitions: int | None = None
) -> RankedGraph:
    """The same fixed point by sending changes only, until all are at most ``tol``.

    A node passes on what its rank just gained, once, and only if that exceeds
    ``tol``; smaller gains stay with the node and are not passed on later.

    A round writes the gains of the nodes that have any, not all nodes; every ``FOLD`` rounds
    these are added up.
    """
    graph = checked(graph)
    header = graph.header.first()
    if not header["num_node"]:
        return RankedGraph(_empty(graph, "page_rank"), graph.edges)
    partitions = partitions or _partitions(graph)
    with _started(graph, ["src", "dst"], header["num_node"], partitions) as start:
        nodes, reset, step = start.totals["nodes"], _double(reset_prob), _double(1.0 - reset_prob)
        most = _most(nodes, reset_prob)
        degrees = start.state.select("id", "out_degree")
        gains = degrees.selectExpr("id", "out_degree", f"{reset} AS delta")
        added, log = None, []
        sending = start.totals["senders"] if reset_prob > tol else 0
        while sending:
            sends = f"delta > {_double(tol)}"
            inflow = start.links.inflow(_shares(gains.where(sends), "delta / out_degree"), "share", most)
            received = degrees.join(hashed(inflow, nodes, partitions), "id")
            gains, seen = _next_round(
                received.selectExpr("id", "out_degree", f"{step} * inflow AS delta"),
                sending=f"count_if({sends} AND out_degree > 0)",
            )
            log.append(gains)
            sending = seen["sending"]
            if len(log) == FOLD or not sending:
                folded, added, log = added, _added(added, log, most), _let_go(log, bool(sending))
                discard(folded)
        if added is None:
            return RankedGraph(degrees.selectExpr("id", f"{reset} AS page_rank"), graph.edges)
        ranks = degrees.join(hashed(added, nodes, partitions), "id", "left")
        state = checkpoint(ranks.selectExpr("id", f"{reset} + coalesce(gained, 0D) AS page_rank"))
        discard(added)
    return RankedGraph(state, graph.edges)


def _added(added: DataFrame | None, log: list[DataFrame], bound: float) -> DataFrame:
    """id, gained: the gains of some rounds on top of what was added up before."""
    parts = [frame.selectExpr("id", "delta AS gained") for frame in log] + ([added] if added is not None else [])
    return checkpoint(reduce(DataFrame.union, parts).groupBy("id").agg(F.expr(f"{exact_sum('gained', bound)} AS gained")))


def _let_go(log: list[DataFrame], more: bool) -> list[DataFrame]:
    """Delete rounds that have been added up; the last one is still to be passed on if there are ``more``."""
    for frame in log[: -1 if more else None]:
        discard(frame)
    return []


def _most(nodes: int, *ranks: float) -> float:
    """What unnormalised ranks of so many nodes sum to at most, given where they start."""
    return 2.0 * nodes * max(1.0, *ranks)


@contextmanager
def _started(graph: Graph, link_columns: list[str], count: int, partitions: int) -> Iterator[_Start]:
    """Nodes with their outgoing counts and sums, hashed by id; links laid out alike, and
    released whatever happens in the rounds. Holds the fixed layout meanwhile."""
    with fixed_layout(graph.vertices.sparkSession, partitions):
        start = _start(graph, link_columns, count, partitions)
        try:
            yield start
        finally:
            start.links.release()


def _start(graph: Graph, link_columns: list[str], count: int, partitions: int) -> _Start:
    if "weight" in link_columns:
        most = graph.edges.agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("links")).first()
        weights = (most["weight"] or 1.0) * max(1, most["links"])
        node_weight = graph.vertices.agg(F.max("node_weight").alias("most")).first()["most"] * count
        total = exact_sum("weight", weights)
    else:
        total = "NULL"
    weighted = "weight" in link_columns
    sent = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"), F.expr(f"{total} AS out_weight"))
    nodes = graph.vertices.select("id", "node_weight").repartition(partitions, "id")
    state = nodes.join(hashed(sent, count, partitions), nodes["id"] == sent["src"], "left").select(
        "id", "node_weight", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "out_weight"
    )
    outer = {}
    if weighted:
        entered = graph.edges.select(F.col("dst").alias("id")).distinct().withColumn("entered", F.lit(True))
        state = state.join(hashed(entered, count, partitions), "id", "left").na.fill(False, ["entered"])
        outer = {
            "outer": "count_if(NOT entered)",
            "outer_senders": "count_if(NOT entered AND out_degree > 0)",
            "outer_weight": exact_sum("if(entered, 0D, node_weight)", node_weight),
            "outer_dangling": exact_sum("if(entered OR out_degree > 0, 0D, node_weight)", node_weight),
        }
    state, totals = _next_round(
        state,
        nodes="count(*)",
        node_weight=exact_sum("node_weight", node_weight) if weighted else "count(*)",
        senders="count_if(out_degree > 0)",
        links="sum(out_degree)",
        largest="max(out_degree)",
        **outer,
    )
    links = links_by_source(
        graph.edges.select(*link_columns), state, count, totals["links"], totals["largest"], partitions
    )
    return _Start(state, links, totals)


def _shares(state: DataFrame, share: str) -> DataFrame:
    """src, out_degree, share of every node that has outgoing links."""
    return state.where("out_degree > 0").selectExpr("id AS src", "out_degree", f"{share} AS share")


def _next_round(state: DataFrame, passing: Sequence[str] = (), **scalars: str) -> tuple[DataFrame, dict]:
    """Checkpoint a round without its ``passing`` columns, which only the scalars read; these are
    gathered by the very job that writes it."""
    seen = Observation()
    state = state.observe(seen, *[F.expr(f"{sql} AS {name}") for name, sql in scalars.items()])
    return checkpoint(state.drop(*passing)), seen.get


def _sum_or_zero(value: str, bound: float) -> str:
    return f"coalesce({exact_sum(value, bound)}, 0D)"


def _partitions(graph: Graph) -> int:
    header = graph.header.first()
    rows = max(header["num_node"], header["link_lines"])
    cores = graph.vertices.sparkSession.sparkContext.defaultParallelism
    return max(partitions_for(rows, MOST_LINKS), min(cores, partitions_for(rows, LEAST_LINKS)))


def _double(value: float) -> str:
    return f"{float(value)!r}D"


def _empty(graph: Graph, *columns: str) -> DataFrame:
    return graph.vertices.select("id", *[F.lit(None).cast("double").alias(c) for c in columns]).where(F.lit(False))
