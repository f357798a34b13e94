"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, join_hot, store


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes with a link (a, b); root is the least node of the component.

    Every round joins the greater neighbours of each node to its least neighbour, then the lesser ones, until nothing
    changes; the rounds grow with the logarithm of a component's size. Leasts are aggregated, and a node with many
    neighbours meets them by broadcast, so a component of a third of all nodes is no hot key.
    """
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        rows = 2 * state[0]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("copies")), rows))
        moved = join_hot(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(few(moved.distinct(), rows))
        least = store(few(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("copies")), rows))
        joined = join_hot(large, least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = store(few(small.distinct(), rows))
