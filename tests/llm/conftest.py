import pytest

from . import tables


def _written(spark, folder, empty):
    for name, (rows, schema) in tables.TABLES.items():
        frame = spark.createDataFrame([] if empty else rows(), schema)
        (frame.coalesce(1) if empty else frame.repartition(3)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    return _written(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _written(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.fixture(scope="session")
def wide(spark, tmp_path_factory):
    """A folder with embeddings of 64 components."""
    folder = tmp_path_factory.mktemp("wide")
    frame = spark.createDataFrame(tables.wide_embeddings(), tables.EMBEDDINGS)
    frame.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)
