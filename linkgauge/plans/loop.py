"""What every multi-round job here needs: a shared folder, tables written to it,
a fixed hash layout for the rounds, and clean-up of rounds no longer needed."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_PARTITION = 100_000
#: Partitions of a loop at most, unless a caller says otherwise; beyond them partitions
#: grow, and joins go over to sorting when a hash table would exceed BUILD_ROWS.
MOST_PARTITIONS = 20_000
BUILD_ROWS = 5_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The session decides (``spark.checkpoint.dir``, or a folder set on the
    context). Only a local master, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="linkgauge-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def store(frame: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar: later readers fetch only
    the columns they use, and lost executors cost no recomputation.
    """
    spark = frame.sparkSession
    path = new_table(spark)
    with shuffles_dropped(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint; inside ``fixed_layout`` it keeps the hash layout."""
    checkpoint_folder(frame.sparkSession)
    with shuffles_dropped(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)


def discard(frame: DataFrame | None) -> None:
    """Delete the files of a checkpoint that no later round reads."""
    if frame is None:
        return
    context = frame.sparkSession.sparkContext
    written = frame._jdf.logicalPlan().rdd().getCheckpointFile()
    if written.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(rows: int, per_partition: int | None = None, most: int = MOST_PARTITIONS) -> int:
    """Hash partitions for a loop over ``rows`` rows: about 100,000 rows each unless
    given, and at most ``most``."""
    return min(max(1, math.ceil(rows / (per_partition or ROWS_PER_PARTITION))), most)


def hashed(build: DataFrame, rows: int, partitions: int) -> DataFrame:
    """The side of a join that becomes a hash table, of ``rows`` rows in all partitions
    together, if such a table fits into a task; else Spark sorts, which can spill."""
    return build.hint("shuffle_hash") if rows <= BUILD_ROWS * partitions else build


def append(frame: DataFrame, path: str) -> None:
    """Add rows to a table in the shared folder, for loops whose result grows by round."""
    with shuffles_dropped(frame.sparkSession):
        frame.write.mode("append").parquet(path)


def new_table(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that is no longer read."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For jobs whose result is written out: their shuffle files go when they end, not when the driver next collects garbage."""
    with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """For tables whose rows are large: few of them go to Python at a time."""
    with _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):
        yield


@contextmanager
def fixed_layout(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Settings for a loop whose tables are laid out once and joined every round.

    The invariant links and the state are hash partitioned on the same keys, into
    the same number of partitions, so their joins need no exchange. Adaptive plans
    do not report the layout of a checkpointed result, which would add two
    exchanges of the state to every round. The skew that adaptive execution would
    look for is treated explicitly in the layout (see ``operators.layout``).
    """
    with _set(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}):
        yield


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
