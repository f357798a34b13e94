"""Positions 1..n over a whole table, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loop import store

# Documented layout of monotonically_increasing_id: partition above, row below.
ROW_BITS = 33


def with_position(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the row's place 1..n in ``order``.

    Rows are range partitioned and sorted; a row's place is its place within its
    partition plus the size of all partitions before. ``order`` should end in a
    unique column: places are then the same on every run, and a third of rows that
    tie on the first column still spread over many partitions.
    """
    numbered = store(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", ROW_BITS))
    )
    # One row per partition, so neither the window nor the broadcast grows with rows.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return numbered.join(F.broadcast(offsets), "_part").select(*frame.columns, place.alias(name))


# The metrics that get a position, with the name of the position.
RANKED = {
    "in_degree": "cite_count_rank",
    "page_rank": "page_rank_rank",
    "betweenness": "betweenness_rank",
}


def rank_positions(metrics: DataFrame) -> DataFrame:
    """Add each node's position, from 1 in descending order, by citations, PageRank
    and betweenness; ties go by id.

    Only ids and one metric at a time are sorted; rows meet their positions by a number of their own.
    """
    rows = store(metrics.withColumn("_key", F.monotonically_increasing_id()))
    frame = rows
    for metric, position in RANKED.items():
        placed = with_position(rows.select("_key", "id", metric), [F.col(metric).desc(), F.col("id").asc()], position)
        frame = frame.join(placed.select("_key", position), "_key")
    return frame.drop("_key")
