import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linkgauge-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pajek(spark, tmp_path):
    """Write text to a file and read it as a network."""
    from linkgauge import read_pajek

    def read(text, name="graph.net"):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return read_pajek(spark, str(path))

    return read


@pytest.fixture
def graph_of(spark):
    """A graph from (src, dst[, weight]) tuples and an optional {id: node weight}."""
    from linkgauge import graph_from_edges, stored

    def build(links, nodes=None):
        rows = [(str(a), str(b), float(w[0]) if w else 1.0) for a, b, *w in links]
        frame = spark.createDataFrame(rows, "src string, dst string, weight double")
        given = None
        if nodes is not None:
            given = spark.createDataFrame([(str(i), float(w)) for i, w in nodes.items()], "id string, w double")
        return stored(graph_from_edges(frame, weight="weight", vertices=given, node_weight="w" if nodes else None))

    return build
