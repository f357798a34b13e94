"""Sums of doubles that don't depend on the order of their terms.

A sum of doubles rounds after every term, so its last digits change with partitions and task order. Here each term is
split into two whole numbers, above and below a fixed binary place; whole numbers add exactly in any order, before and
after a shuffle, and are put together once at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary digits of the sums above the place, and of each term below it. Terms below may be as many as 2**32.
HIGH, LOW = 62, 31
#: Powers of two that are doubles, with room for LOW.
LEAST_SHIFT, MOST_SHIFT = -900, 900


def exact_sum(value: str, bound: float) -> str:
    """SQL of the sum of an expression whose sizes sum up to no more than ``bound``; what a term has below
    bound / 2**93 is cut off."""
    shift = max(LEAST_SHIFT, min(MOST_SHIFT, HIGH - math.ceil(math.log2(bound)))) if bound > 0 else 0
    scaled = f"(({value}) * {2.0**shift!r}D)"
    high = f"cast({scaled} as bigint)"
    low = f"cast(({scaled} - {high}) * {2.0**LOW!r}D as bigint)"
    return f"(sum({high}) * {2.0**-shift!r}D + sum({low}) * {2.0 ** -(shift + LOW)!r}D)"


def exact_total(frame: DataFrame, column: str) -> DataFrame:
    """One row ``total``: the sum of a column, its place chosen by its greatest value and the number of rows. Lazy."""
    sizes = frame.agg(F.max(F.abs(F.col(column))).alias("_most"), F.count(column).alias("_rows"))
    place = F.ceil(F.log2(F.greatest("_most", F.lit(1e-250)))) + F.ceil(F.log2(F.greatest("_rows", F.lit(1))))
    sized = sizes.select((F.lit(HIGH) - place).cast("double").alias("_shift"))
    rows = frame.select(F.col(column).alias("_value")).crossJoin(F.broadcast(sized))
    scaled = F.col("_value") * F.pow(F.lit(2.0), F.col("_shift"))
    high = scaled.cast("long")
    low = ((scaled - high) * F.lit(2.0**LOW)).cast("long")
    sums = rows.agg(F.sum(high).alias("high"), F.sum(low).alias("low"), F.max("_shift").alias("shift"))
    total = (F.col("high") + F.col("low") * F.lit(2.0**-LOW)) * F.pow(F.lit(2.0), -F.col("shift"))
    return sums.select(F.coalesce(total, F.lit(0.0)).alias("total"))
