"""Column expressions shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text patterns of the two file formats.
TRIM_RE = r"^[\x00-\x20]+|[\x00-\x20]+$"
NODE_RE = r'^(.*?)\s*"(.*)"\s*(.*)$'
HEAD_LINE_RE = r"(?i)^\*(vertices.|edges.|arcs.)"
HEAD_RE = r"(?i)^\*(vertices|edges|arcs)\s+([+-]?\d+)$"
SEP_RE = r"\|\|"


def trimmed(text: Column) -> Column:
    """Strip every character up to the blank, control characters included."""
    return F.regexp_replace(text, TRIM_RE, "")


def positive_or_one(number: Column) -> Column:
    """A usable weight: absent, NaN, zero and negative numbers count as 1.0.

    Spark orders NaN above all numbers, hence the separate test.
    """
    number = number.cast("double")
    return F.when((number > 0) & ~F.isnan(number), number).otherwise(F.lit(1.0))


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0.0))
