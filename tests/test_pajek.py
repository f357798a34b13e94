import pytest

import linkgauge.sources.pajek as source
from linkgauge import GraphError, read_pajek, write_pajek
from tests import fixtures


def vertices(graph):
    return {r["id"]: (r["name"], r["node_weight"]) for r in graph.vertices.collect()}


def edges(graph):
    return {(r["src"], r["dst"]): r["weight"] for r in graph.edges.collect()}


@pytest.mark.parametrize(
    "text, nodes, links", [(fixtures.FIVE, 5, 10), (fixtures.CLASSIC, 15, 25), (fixtures.FAMILIES, 15, 40)]
)
def test_networks(pajek, text, nodes, links):
    graph = pajek(text)
    assert graph.header.first().asDict() == {
        "num_node": nodes, "num_link": links, "node_lines": nodes, "link_lines": links, "total_node_weight": nodes,
    }
    assert len(vertices(graph)) == nodes
    assert len(edges(graph)) == links
    assert set(edges(graph).values()) == {1.0}


def test_reader_rules(pajek):
    graph = pajek(
        "1 before any section\n\n"
        "*vertices 4\r\n"
        '  1 "plain"  \n'
        '\t2 "has "inner" quotes" 2.5\n'
        "\n"
        '3 "a | b || c" 0\n'
        '4 "" -1 \n'
        "*EDGES 5\n"
        "1 2 NaN\n"
        "2  3   4.5 ignored\n"
        "3 1\n"
        "4 4 0\n"
        "4 1 -2\n"
    )
    assert vertices(graph) == {
        "1": ("plain", 1.0), "2": ('has "inner" quotes', 2.5), "3": ("a | b || c", 1.0), "4": ("", 1.0),
    }
    assert edges(graph) == {
        ("1", "2"): 1.0, ("2", "3"): 4.5, ("3", "1"): 1.0, ("4", "4"): 1.0, ("4", "1"): 1.0,
    }


def test_last_wins_but_all_lines_count(pajek):
    graph = pajek('*Vertices 2\n1 "a" 3\n1 "b" 4\n2 "c"\n*Arcs 3\n1 2 2\n1 2 9\n1 2 5\n')
    assert vertices(graph) == {"1": ("b", 4.0), "2": ("c", 1.0)}
    assert edges(graph) == {("1", "2"): 5.0}
    header = graph.header.first()
    assert (header["num_link"], header["link_lines"], header["node_lines"]) == (3, 3, 3)
    assert header["total_node_weight"] == 8.0


def test_second_link_section(pajek):
    text = '*Vertices 2\n1 "a"\n2 "b"\n*Arcs 1\n1 2\n*Edges {}\n2 1\n'
    assert edges(pajek(text.format(2))) == {("1", "2"): 1.0, ("2", "1"): 1.0}
    with pytest.raises(GraphError, match="1 links declared, 2 link lines"):
        pajek(text.format(1), "other.net")


NODES = '*Vertices 2\n1 "a"\n2 "b"\n'


@pytest.mark.parametrize(
    "text, message",
    [
        ('*Vertices 3\n1 "a"\n2 "b"\n', "3 nodes declared, 2 distinct"),
        (NODES + "*Arcs 2\n1 2\n", "2 links declared, 1 link lines"),
        (NODES + "*Arcs 1\n1 7\n", "unknown nodes.*7"),
        (NODES + "*Arcs 1\n1 2 x\n", "link weight that is no number"),
        ('*Vertices 1\n1 "a" heavy\n', "node weight that is no number"),
        ("*Vertices 1\n1 a\n", "node line without"),
        ('*Vertices 1\n1 "a\n', "node line without"),
        (NODES + "*Arcs 1\n1\n", "link line without two ids"),
        ("*Vertices many\n", "section head without a count"),
    ],
)
def test_malformed(pajek, text, message):
    with pytest.raises(GraphError, match=message):
        pajek(text)


def test_empty(pajek):
    graph = pajek("")
    assert graph.header.first()["num_node"] == 0
    assert graph.vertices.isEmpty() and graph.edges.isEmpty()


def test_many_splits_and_many_heads(spark, tmp_path):
    """Sections and last-wins hold when the file is read in many blocks, and when it
    has very many heads."""
    count = 300
    lines = ["ignored"]
    for i in range(count):
        lines += [f"*Vertices {count}", f'{i} "node {i}" {i + 1}']
        lines += [f"*Arcs {2 * count}", f"{i} {max(i - 1, 0)} {i + 1}", f"{i} {max(i - 1, 0)} {i + 2}"]
    path = tmp_path / "many.net"
    path.write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        graph = read_pajek(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert vertices(graph) == {str(i): (f"node {i}", i + 1.0) for i in range(count)}
    assert edges(graph) == {(str(i), str(max(i - 1, 0))): i + 2.0 for i in range(count)}


@pytest.mark.parametrize("per_range", [1, 3, 4096])
def test_sections_of_many_blocks(spark, tmp_path, per_range):
    """Sections against a walk over the text, with blocks that have no head, one or several."""
    path, expected, section = tmp_path / "net.net", [], None
    text = ["first"]
    for i in range(300):
        if i % 37 == 0 or i in (50, 51, 52):
            text.append("*Vertices 1" if i % 2 else "*Arcs 1")
        text.append(f"{i} {i}")
    path.write_text("\n".join(text))
    for line in text:
        if line.startswith("*"):
            section = "nodes" if line[1] == "V" else "links"
        else:
            expected.append((line, section))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        lines = source.store(source._read_lines(spark, str(path)))
        blocks = source._blocks(lines, per_range)
        assert blocks.count() > 20
        source_blocks, source._blocks = source._blocks, lambda _: blocks
        try:
            tagged = source._with_section(lines).where("head IS NULL").orderBy("place").collect()
        finally:
            source._blocks = source_blocks
    finally:
        spark.conf.set(key, before)
    assert [(r["line"], r["section"]) for r in tagged] == expected


def test_links_are_not_sorted(spark, capsys):
    """Only numbers are carried along per pair, so Spark aggregates by hash."""
    links = spark.createDataFrame([], "place long, src string, dst string, weight double, bad_line boolean, bad_weight boolean, line string")
    source._last_links(links.repartition(2)).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_round_trip(spark, pajek, tmp_path):
    graph = pajek('*Vertices 3\n1 "a b" 0.25\n2 "q"uote"\n3 "c" 1e-7\n*Arcs 2\n1 2 0.1\n3 1 2500000\n')
    write_pajek(graph, str(tmp_path / "parts"))
    again = read_pajek(spark, str(tmp_path / "parts"))
    assert vertices(again) == vertices(graph)
    assert edges(again) == edges(graph)
    assert again.header.first() == graph.header.first()


def test_parts_beyond_five_digits(spark, tmp_path):
    """Part numbers count, not the order of names."""
    parts = {"part-00000-x.txt": '*Vertices 2\n1 "a"\n2 "b"\n', "part-10001-x.txt": "*Arcs 2\n1 2 3\n", "part-100000-x.txt": "1 2 7\n"}
    for name, text in parts.items():
        (tmp_path / name).write_text(text)
    from linkgauge import read_pajek

    assert [tuple(r) for r in read_pajek(spark, str(tmp_path)).edges.collect()] == [("1", "2", 7.0)]


@pytest.mark.parametrize("ids, names", [(["a b", "c"], ["x", "y"]), (['a"', "c"], ["x", "y"]), (["a", "c"], [None, "y"]), (["a", "c"], ["x\ny", "y"])])
def test_writer_refuses_what_it_cannot_write(spark, tmp_path, ids, names):
    import linkgauge as lg

    vertices = spark.createDataFrame(list(zip(ids, names)), "id string, name string")
    links = spark.createDataFrame([tuple(ids)], "src string, dst string")
    graph = lg.stored(lg.graph_from_edges(links, vertices=vertices, name="name"))
    with pytest.raises(lg.GraphError, match="written"):
        lg.write_pajek(graph, str(tmp_path / "out"))
