"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
Whole texts are read, however long. An empty table gives an empty result. Columns other than those that a stage reads are carried along
by all but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkgauge.llm import mixing, pieces, quality, simhash, substring
from linkgauge.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts have no words and go. Null languages and sources are groups like others. Repeated rows are judged each.
    """
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicate fingerprints: that with the least id.

    Texts without words, null ones too, share fingerprint 0 and are linked like others. A document without an id stays only if its component has
    none with one. Of rows with the same least id, the one with the least hash of its text stays, and so one of exact repeats.
    """
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has too.

    A null text stays null. Documents without an id neither lose nor take anything, and rows with the same id take nothing from one another.
    A document that loses all its words stays, with an empty text.
    """
    return substring.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    A null source is one of its own. A source without words has rate 0, so its documents go; in others, documents without words are
    taken at the source's rate. Repeated rows and rows without an id draw each for itself.
    """
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text: doc_id, n_tokens, token_ids, round_trip.

    A null text has null pieces, an empty one none. Rows with equal ids and texts get equal pieces; a null id is an id like others.
    """
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("encoding", encoding),
]

#: SQL can't express the estimates, fingerprints and samples; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
