"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.plans.loop import checkpoint_folder, partitions_for, store

__all__ = ["BLANKS", "WORD", "expand", "few", "fresh", "frugal", "join_hot", "lower_az", "scratch", "store", "table", "word_count"]

#: Blanks between words; a word is a run of other characters.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies that one array of ``expand`` holds at most.
STEP = 4096
#: A key is hot if more rows than this have it, and more than a MOST_HOT-th of all; so no more than MOST_HOT keys are.
HOT, MOST_HOT = 1000, 50_000


def frugal(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``work`` on batches, which gives back what memory it no longer needs once a task ends.

    A Python worker lives on into later stages, and keeps what earlier ones grew to otherwise. Type hints stay those of ``work``.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def few(frame: DataFrame, rows: int) -> DataFrame:
    """For a table of about so many rows, most often the output of a shuffle: no more tasks than they are worth, and one for each core."""
    return frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, partitions_for(rows)))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, whatever its own columns are called."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_az(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def expand(frame: DataFrame, copies: str, index: str) -> DataFrame:
    """Each row as often as its column ``copies`` says, numbered from 0 in ``index``.

    Two short arrays in a row, so a row with millions of copies never makes one long array.
    """
    block = fresh(frame, "block")
    return (
        frame.where(F.col(copies) > 0)
        .withColumn(block, F.explode(F.sequence(F.lit(0), ((F.col(copies) - 1) / STEP).cast("long"))))
        .withColumn(
            index,
            F.explode(F.sequence(F.col(block) * STEP, F.least(F.col(copies), (F.col(block) + 1) * STEP) - 1)),
        )
        .drop(block)
    )


def join_hot(rows: DataFrame, side: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """Inner join of ``rows`` with ``side``, a stored table of one row for each key that says in ``copies`` how many rows have it.

    Rows of hot keys stay where they are and meet their few keys by broadcast.
    """
    seen = side.agg(F.sum(copies).alias("rows"), F.max(copies).alias("most")).first()
    limit = max(HOT, (seen["rows"] or 0) // MOST_HOT)
    plain = side.drop(copies)
    if (seen["most"] or 0) <= limit:
        return rows.join(plain, key)
    hot = F.broadcast(side.where(F.col(copies) > limit).drop(copies))
    light = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col(copies) <= limit).drop(copies), key)
    return light.unionByName(rows.join(hot, key))
