"""Reader of metrics text, the inverse of the text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SEP_RE, trimmed
from ..schema import METRICS
from ..sinks.metrics_text import HEADER_TEXT


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read rows of ``id || in_degree || page_rank || page_rank_normalized ||
    betweenness || name``, with or without blanks round the separator.

    The header goes wherever it stands, also where a writer left out the line end
    after it, so that the first row follows on the same line.
    """
    text = F.col("value")
    row = F.when(text.startswith(HEADER_TEXT), F.substr(text, F.lit(len(HEADER_TEXT) + 1))).otherwise(text)
    # The name is the last field; it keeps any further separator.
    fields = F.split(row, SEP_RE, len(METRICS))
    columns = [
        trimmed(F.get(fields, F.lit(i))).cast(field.dataType).alias(field.name) for i, field in enumerate(METRICS)
    ]
    return spark.read.text(path).where(trimmed(row) != "").select(*columns)
