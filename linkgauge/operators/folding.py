"""Nodes that hang on one neighbour, taken off a graph before a search and put back afterwards.

A node whose links all go to and from one neighbour is on no shortest path between others; what lies beyond it
is reached through that neighbour alone. Taking such nodes off, again and again, leaves a core, whose nodes stand for what was
taken off: ``s`` sources that leave and ``t`` targets that are reached through them, themselves included. Paths within and between the
parts taken off are counted in closed form, so only the core has to be searched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import store
from .layout import join_per_end

# Rounds of taking off at most, and the part of all nodes that a round has to take off for another one.
# Whatever then still hangs is searched like the rest.
ROUNDS, WORTH = 64, 0.001


@dataclass
class Folded:
    """A core and what was taken off it, nodes given by number.

    core     key, own, s, t, inner    own: 1.0 for a source; inner: pairs of other nodes joined through a node between
                                      parts that hang on it
    links    src, dst of the core
    rounds   what each round took off, with the core's columns and parent, up, down: 1.0 if a link goes there and back
    """

    core: DataFrame
    links: DataFrame
    nodes: int
    rounds: list[DataFrame] = field(default_factory=list)

    def unfolded(self, searched: DataFrame) -> DataFrame:
        """key, score, own, reach of all nodes, from key, score, reach, come of the core: what its searches found, the targets that a
        node reaches and the sources that reach it, itself and all they stand for included."""
        core = store(self.core.join(searched, "key", "left").na.fill(0.0, ["score", "reach", "come"]))
        scores = core.selectExpr("key", "score + inner + (s - own) * (reach - t) + (t - 1) * (come - s) AS score", "own", "reach")
        ends = core.select("key", "reach", "come")
        for taken in reversed(self.rounds):
            counts = taken.groupBy("parent").agg(F.count(F.lit(1)).alias("links"))
            parents = counts.join(ends.withColumnRenamed("key", "parent"), "parent")
            beyond = join_per_end(taken, parents, "parent").selectExpr(
                "key", "own", "s", "t", "inner", "up * (reach - down * t) AS farther", "down * (come - up * s) AS before"
            )
            beyond = store(beyond)
            scores = scores.union(beyond.selectExpr("key", "inner + (s - own) * farther + (t - 1) * before AS score", "own", "t + farther AS reach"))
            ends = ends.union(beyond.selectExpr("key", "t + farther AS reach", "s + before AS come"))
        return scores


def fold(nodes: DataFrame, links: DataFrame) -> Folded:
    """Take off what hangs on one neighbour. ``nodes`` has key and own, ``links`` distinct src, dst without self-loops."""
    state = store(nodes.selectExpr("key", "own", "0D AS p", "0D AS q", "0D AS both"))
    number = left = state.count()
    rounds: list[DataFrame] = []
    while len(rounds) < ROUNDS:
        ends = links.selectExpr("src AS key", "dst AS parent", "1D AS up", "0D AS down").union(
            links.selectExpr("dst", "src", "0D", "1D")
        )
        sides = ends.groupBy("key", "parent").agg(F.max("up").alias("up"), F.max("down").alias("down"))
        one = sides.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("parent", "up", "down")]
        ).where("n = 1").drop("n")
        one = store(one)
        # of two nodes that hang on each other the lesser one stays
        pairs = one.selectExpr("parent AS key", "key AS of")
        leaves = one.join(pairs.where("of < key").select(F.col("of").alias("parent"), "key"), ["key", "parent"], "left_semi").union(
            one.join(pairs.select(F.col("of").alias("parent"), "key"), ["key", "parent"], "left_anti")
        )
        taken = store(state.join(leaves, "key").selectExpr(
            "key", "own", "own + p AS s", "1 + q AS t", "p * q - both AS inner", "parent", "up", "down"
        ))
        off = taken.count()
        if off < max(1, WORTH * number):
            break
        rounds.append(taken)
        gained = taken.groupBy("parent").agg(
            F.sum(F.col("up") * F.col("s")).alias("more_p"), F.sum(F.col("down") * F.col("t")).alias("more_q"),
            F.sum(F.col("up") * F.col("s") * F.col("down") * F.col("t")).alias("more_both"),
        ).withColumnRenamed("parent", "key")
        state = store(state.join(taken.select("key"), "key", "left_anti").join(gained, "key", "left").selectExpr(
            "key", "own", *[f"{c} + coalesce(more_{c}, 0D) AS {c}" for c in ("p", "q", "both")]
        ))
        gone = taken.selectExpr("key AS src", "parent AS dst").union(taken.selectExpr("parent", "key"))
        links = store(links.join(gone, ["src", "dst"], "left_anti"))
        left -= off
    core = state.selectExpr("key", "own", "own + p AS s", "1 + q AS t", "p * q - both AS inner")
    return Folded(core, links, left, rounds)
