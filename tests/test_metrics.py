import glob

import pytest

import linkgauge as lg
from linkgauge import GraphError
from linkgauge.schema import METRICS
from linkgauge.sinks import metrics_text as sink
from tests import fixtures
from tests.test_tables import as_dict

HEADER = "* NodeId || InDegree(CiteCnt) || pageRank || pageRankNormalized || betweenness || nodeName"


def text_of(path):
    """The parts of a written text, put together in name order."""
    return "".join(open(part, newline="").read() for part in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("a", 3, 0.5, 5.0, 1.5, "plain"), ("b", 0, 1.0e-9, 1.0e-8, 0.0, "a | b"), ("c", 7, 0.25, 2.5, 1.5, ""),
        ("d", 7, 0.25, 2.5, 9.0, 'with "quotes" || pipes'),
    ]
    return spark.createDataFrame(rows, METRICS)


def test_whole_job(spark, tmp_path):
    """All known networks side by side in one file, with all defaults. Side by side a
    network keeps its betweenness, and its ranks shrink to its part of the nodes."""
    parts = {
        "f": (fixtures.FIVE, fixtures.FIVE_RANK, fixtures.FIVE_BETWEENNESS),
        "c": (fixtures.CLASSIC, fixtures.CLASSIC_RANK, fixtures.CLASSIC_BETWEENNESS),
        "p": (fixtures.FAMILIES, fixtures.FAMILIES_RANK, fixtures.FAMILIES_BETWEENNESS),
    }
    nodes, links, rank, score = [], [], {}, {}
    for tag, (text, ranks, scores) in parts.items():
        head, tail = text.split("*Arcs")
        nodes += [tag + line.strip() for line in head.splitlines()[1:]]
        ends = [line.split() for line in tail.splitlines()[1:] if line.strip()]
        links += [f"{tag}{a} {tag}{b} {w}" for a, b, w in ends]
        rank |= {tag + k: v * len(ranks) / 35 for k, v in ranks.items()}
        score |= {tag + k: v for k, v in scores.items()}
    source = tmp_path / "all.net"
    source.write_text("\n".join(["*Vertices 35", *nodes, "*Arcs 75", *links]))

    out = str(tmp_path / ("all" + sink.METRICS_SUFFIX))
    table = lg.network_metrics(spark, str(source), out, with_betweenness=True)
    assert table.schema.simpleString() == METRICS.simpleString()
    rows = {r["id"]: r for r in lg.read_metrics(spark, out).collect()}
    assert {k: r["page_rank"] for k, r in rows.items()} == pytest.approx(rank, abs=1e-9)
    assert {k: r["page_rank_normalized"] for k, r in rows.items()} == pytest.approx(
        {k: 75 * v for k, v in rank.items()}, abs=1e-7
    )
    assert {k: r["betweenness"] for k, r in rows.items()} == pytest.approx(score, abs=1e-9)
    assert {k[1:]: r["in_degree"] for k, r in rows.items() if k[0] == "f"} == fixtures.FIVE_IN_DEGREE
    assert rows["f2"]["name"] == "B" and rows["c15"]["name"] == "Node 15"


def test_betweenness_off_is_zero(pajek):
    graph = pajek(fixtures.FIVE)
    table = lg.metrics_table(graph, rank=lg.pagerank(graph, max_iter=2, min_iter=1), with_betweenness=False)
    assert set(as_dict(table, "id", "betweenness").values()) == {0.0}


@pytest.mark.parametrize("sep", [sink.SEP_SPACED, sink.SEP_TIGHT])
@pytest.mark.parametrize("header", [True, False])
def test_text_round_trip(spark, frame, tmp_path, sep, header):
    path = str(tmp_path / "out")
    lg.write_metrics_text(frame, path, sep, header)
    lines = text_of(path).splitlines()
    assert (lines[0] == HEADER) == header
    assert sep.join(["a", "3", "0.5", "5.0", "1.5", "plain"]) in lines
    expected = {r["id"]: r for r in frame.collect()}
    assert {r["id"]: r for r in lg.read_metrics(spark, path).collect()} == expected


def test_header_glued_to_first_row(spark, tmp_path):
    path = tmp_path / "glued.csv"
    path.write_text(HEADER + "13 || 1 || 0.0 || 0.0 || 0.0 || Node 13\n\n*4 || 2 || 0.0 || 0.0 || 2.1 || Node 4\n")
    rows = {r["id"]: (r["in_degree"], r["betweenness"], r["name"]) for r in lg.read_metrics(spark, str(path)).collect()}
    assert rows == {"13": (1, 0.0, "Node 13"), "*4": (2, 2.1, "Node 4")}


def test_sorted_file(spark, frame, tmp_path):
    given, ordered = str(tmp_path / "given"), str(tmp_path / sink.SORTED_NAME.format(name="x"))
    lg.write_metrics_text(frame, given)
    lg.sort_metrics_file(spark, given, ordered)
    lines = text_of(ordered).splitlines()
    assert lines[0] == HEADER
    assert [line.split(" || ")[0] for line in lines[1:]] == ["b", "a", "c", "d"]


def test_parquet(spark, frame, tmp_path):
    path = str(tmp_path / "metrics")
    lg.write_metrics_parquet(frame, path)
    assert sorted(spark.read.parquet(path).collect()) == sorted(frame.collect())


def test_score_writers(spark, pajek, tmp_path):
    graph = pajek(fixtures.FIVE)
    static = spark.createDataFrame([("1", 5.0), ("3", 2.5)], "id string, page_rank double")
    path = lg.write_static_rank(static, graph, str(tmp_path), "x")
    assert path.endswith("/SortedPageRankx")
    assert sorted(text_of(path).splitlines()) == [HEADER, "1||1||0.5||5.0||0.0||A", "3||2||0.25||2.5||0.0||C"]
    scores = spark.createDataFrame([("2", 7)], "id string, betweenness int")
    path = lg.write_betweenness(scores, graph, str(tmp_path), "x")
    assert path.endswith("/SortedBetweenessx")
    assert text_of(path).splitlines() == [HEADER, "2||3||0||0||7||B"]
    unknown = spark.createDataFrame([("9", 1.0)], "id string, page_rank double")
    with pytest.raises(GraphError, match="unknown nodes.*9"):
        lg.static_rank_metrics(unknown, graph)


def test_rank_positions(spark):
    count = 500
    rows = [(f"{i:03}", i % 3, float(-i), 0.0 if i % 2 else float(i), 0.0 if i < 400 else 1.0 * i, "") for i in range(count)]
    frame = spark.createDataFrame(rows, METRICS).repartition(7)
    got = {r["id"]: r for r in lg.rank_positions(frame).collect()}
    for metric, position in (
        ("in_degree", "cite_count_rank"), ("page_rank", "page_rank_rank"), ("betweenness", "betweenness_rank"),
    ):
        expected = sorted(got, key=lambda i: (-got[i][metric], i))
        assert [got[i][position] for i in expected] == list(range(1, count + 1))


def test_positions_over_many_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
        rows = lg.with_position(frame, [F.col("k").desc()], "pos")
        assert rows.select("pos", "k").where("pos + k != 1000").isEmpty()
        assert rows.count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sorted_metrics(frame):
    assert [r["id"] for r in lg.sorted_metrics(frame).collect()] == ["b", "a", "c", "d"]
    assert [r["id"] for r in lg.sorted_metrics(frame, "in_degree").collect()] == ["b", "a", "c", "d"]
    with pytest.raises(GraphError):
        lg.sorted_metrics(frame, "size")
