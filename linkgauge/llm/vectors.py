"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & numbers, F.lit(False))


def scaled(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of every component x as double; raises beyond ``most``, where exact sums would overflow."""
    def component(x: Column) -> Column:
        value = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double")) * scale <= F.lit(float(most)), value).otherwise(
            F.raise_error(F.lit(f"a component beyond {most} / {scale} in size")).cast("long")
        )

    return F.transform(vector, component)


def whole_vectors(frame: DataFrame, id: str, column: str, scale: int, most: int) -> DataFrame:
    """Rows (vec_id, vector) of whole numbers, from rows whose vector is finite."""
    kept = frame.where(is_finite(F.col(column)))
    return kept.select(F.col(id).cast("long").alias("vec_id"), scaled(F.col(column), scale, most).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row of numbers for each list of an Arrow column, all lists of the same width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
