"""Reader and writer of networks in Pajek text form.

    *Vertices 3
    1 "first node" 1.0
    2 "second node" 2.0
    3 "third node"
    *Arcs 2
    1 2 1.7
    3 2

Which section a line belongs to depends on the lines before it, also when the
text is split over many tasks. The lines are therefore written once, with the
block of the file they were read from, and every later step works on that table:
places stay the same however a later job would split the file. Blocks are numbered
in the order of the text, and a line's place is one number made of its block's and its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import HEAD_LINE_RE, HEAD_RE, NODE_RE, positive_or_one, trimmed
from ..operators.positions import ROW_BITS, with_position
from ..plans.loop import store
from ..schema import Graph, GraphError
from .tables import check_declared_counts, check_endpoints, header_row

# Blocks and section heads, together, up to which their table is broadcast to the lines (about 10 MB).
BROADCAST_BLOCKS = 100_000

# Blocks that one task follows to find which section is open where a block begins.
BLOCKS_PER_RANGE = 4096


def read_pajek(spark: SparkSession, path: str) -> Graph:
    """Read one network: a file, or a folder of parts that form one text in the order
    of their part numbers, else of their names.

    ``*Edges`` are directed like ``*Arcs``. Duplicate nodes and links: the last one
    wins, but every node line's weight enters the total and every link line the
    link count. Raises GraphError for a malformed line, a declared count that
    differs from what is there, or a link to an unknown node.
    """
    tagged = _with_section(store(_read_lines(spark, path)))
    body = tagged.where(F.col("head").isNull())
    nodes = body.where(F.col("section") == "nodes").select("place", *_node_fields())
    links = body.where(F.col("section") == "links").select("place", *_link_fields())
    vertices, edges = store(_last_nodes(nodes)), store(_last_links(links))

    heads = tagged.where(F.col("head").isNotNull()).select("place", "head", "line")
    totals = _checked_totals(heads, nodes, vertices, links, edges)
    declared = _declared_counts(heads)
    num_node, num_link = declared.get("nodes", 0), declared.get("links", 0)
    check_declared_counts(num_node, vertices.count(), num_link, totals["link_lines"])
    header = header_row(
        spark, num_node, num_link, totals["node_lines"], totals["link_lines"], totals["total_node_weight"]
    )
    graph = Graph(vertices.select("id", "name", "node_weight"), edges.select("src", "dst", "weight"), header)
    return check_endpoints(graph)


def write_pajek(graph: Graph, path: str) -> None:
    """Write a network as a folder of text parts that ``read_pajek`` reads back.

    Links and nodes are written once each, and counted so in the heads. A graph that was read from lines with duplicates comes back with fewer
    lines in its header, which changes what is scaled by them, such as ``page_rank_normalized``.

    Raises GraphError for what would be read back as something else: an id that is empty, null
    or has a blank or quote, a name that is null or has a line end.
    """
    spark = graph.vertices.sparkSession
    ids = [F.col(c).cast("string") for c in ("src", "dst")]
    bad_ends = graph.edges.where(~_plain(ids[0]) | ~_plain(ids[1])).select(*ids)
    bad_nodes = graph.vertices.where(
        ~_plain(F.col("id").cast("string")) | F.col("name").isNull() | F.col("name").rlike(r"[\r\n]")
    ).select(F.col("id").cast("string"), "name")
    bad = bad_nodes.limit(3).collect() or bad_ends.limit(3).collect()
    if bad:
        raise GraphError(f"cannot be written as text: {[tuple(row) for row in bad]}")
    counts = graph.header.first()

    def head(text: str) -> DataFrame:
        return spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))

    nodes = graph.vertices.select(
        F.concat(F.col("id"), F.lit(' "'), F.col("name"), F.lit('" '), F.col("node_weight").cast("string"))
    )
    links = graph.edges.select(F.concat_ws(" ", "src", "dst", F.col("weight").cast("string")))
    (
        head(f"*Vertices {counts['num_node']}").union(nodes)
        .union(head(f"*Arcs {graph.edges.count()}")).union(links)
        .write.text(path)
    )


def _plain(id: Column) -> Column:
    return F.coalesce(id.rlike(r'^[^\s"]+$'), F.lit(False))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines with what places them: part number, file, block of the file, row.

    Row numbers only grow within a block, which one task reads from end to end.
    """
    text = spark.read.text(path).select(
        # Spark pads part numbers to five digits only, so names alone would put 100000 before 10001.
        F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long"), F.lit(0)).alias("part"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        trimmed(F.col("value")).alias("line"),
    )
    is_head = F.col("line").rlike(HEAD_LINE_RE)
    kind = F.when(F.lower(F.substring("line", 2, 1)) == "v", "nodes").otherwise("links")
    return text.where(F.col("line") != "").withColumn("head", F.when(is_head, kind))


def _blocks(lines: DataFrame, per_range: int = BLOCKS_PER_RANGE) -> DataFrame:
    """Stored rows (file, block, number, opening, heads): the blocks numbered in order, the section that is
    open where each begins, and its section heads.

    The section is the last one of the blocks before in a range of blocks, else that of the ranges before.
    """
    head = F.when(F.col("head").isNotNull(), F.struct("row", "head"))
    blocks = lines.groupBy("part", "file", "block").agg(F.sort_array(F.collect_list(head)).alias("heads"))
    numbered = with_position(blocks, [F.col("part"), F.col("file"), F.col("block")], "number").withColumns({
        "range": F.floor((F.col("number") - 1) / per_range),
        "closing": F.get("heads", F.size("heads") - 1)["head"],
    })
    last = F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("number")))
    ranges = numbered.groupBy("range").agg(last.alias("closing"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.last("closing", ignorenulls=True).over(before).alias("earlier"))
    within = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.coalesce(F.last("closing", ignorenulls=True).over(within), F.col("earlier"))
    return store(numbered.join(ranges, "range").select("file", "block", "number", opening.alias("opening"), "heads"))


def _with_section(lines: DataFrame) -> DataFrame:
    """Rows (place, line, head, section) of stored lines; lines before any head have no section."""
    blocks = _blocks(lines)
    held = blocks.agg(F.coalesce(F.sum(F.size("heads") + 1), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(blocks) if held <= BROADCAST_BLOCKS else blocks
    row = F.col("row")
    section = F.aggregate("heads", F.col("opening"), lambda open, head: F.when(head["row"] < row, head["head"]).otherwise(open))
    place = F.shiftleft("number", ROW_BITS) + row.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return lines.join(side, ["file", "block"]).select(place.alias("place"), "line", "head", section.alias("section"))


def _weight_fields(text: Column, name: str) -> list[Column]:
    number = text.try_cast("double")
    return [
        positive_or_one(number).alias(name),
        (text.isNotNull() & (text != "") & number.isNull()).alias("bad_weight"),
    ]


def _node_fields() -> list[Column]:
    line = F.col("line")
    id = F.regexp_extract(line, NODE_RE, 1)
    return [
        id.alias("id"),
        F.regexp_extract(line, NODE_RE, 2).alias("name"),
        *_weight_fields(F.regexp_extract(line, NODE_RE, 3), "node_weight"),
        (~line.rlike(NODE_RE) | (id == "")).alias("bad_line"),
        line,
    ]


def _link_fields() -> list[Column]:
    line = F.col("line")
    tokens = F.split(line, r"\s+")
    return [
        F.get(tokens, F.lit(0)).alias("src"),
        F.get(tokens, F.lit(1)).alias("dst"),
        *_weight_fields(F.get(tokens, F.lit(2)), "weight"),
        (F.size(tokens) < 2).alias("bad_line"),
        line,
    ]


def _sums(weight: str) -> list[Column]:
    """What the checks need of all lines of a key."""
    return [
        F.count(F.lit(1)).alias("lines"), F.sum(weight).alias("weights"),
        F.count_if("bad_line").alias("bad_lines"), F.count_if("bad_weight").alias("bad_weights"),
    ]


def _last_nodes(nodes: DataFrame) -> DataFrame:
    """The last line of each id. Names are text, so Spark sorts here; nodes are few beside links."""
    last = F.max_by(F.struct("name", "node_weight"), "place").alias("last")
    return nodes.groupBy("id").agg(last, *_sums("node_weight")).select("id", "last.*", "lines", "weights", "bad_lines", "bad_weights")


def _last_links(links: DataFrame) -> DataFrame:
    """The last line of each pair; only numbers are carried, so links are hashed and not sorted."""
    return links.groupBy("src", "dst").agg(F.max_by("weight", "place").alias("weight"), *_sums("weight"))


def _checked_totals(
    heads: DataFrame, nodes: DataFrame, vertices: DataFrame, links: DataFrame, edges: DataFrame
) -> dict:
    """Line counts and the total node weight; raises on the first kind of bad line."""
    sums = [F.sum(c).alias(c) for c in ("lines", "weights", "bad_lines", "bad_weights")]
    of_nodes, of_links = vertices.agg(*sums).first(), edges.agg(*sums).first()
    bad_heads = heads.where(~F.col("line").rlike(HEAD_RE))
    for what, number, bad in (
        ("section head without a count", bad_heads.count(), bad_heads),
        ("node line without an id and a quoted name", of_nodes["bad_lines"], nodes.where("bad_line")),
        ("link line without two ids", of_links["bad_lines"], links.where("bad_line")),
        ("node weight that is no number", of_nodes["bad_weights"], nodes.where("bad_weight")),
        ("link weight that is no number", of_links["bad_weights"], links.where("bad_weight")),
    ):
        if number:
            raise GraphError(f"{what}: {bad.agg(F.max('line')).first()[0]!r}")
    return {
        "node_lines": of_nodes["lines"] or 0, "link_lines": of_links["lines"] or 0,
        "total_node_weight": of_nodes["weights"] or 0.0,
    }


def _declared_counts(heads: DataFrame) -> dict[str, int]:
    """The count in the last head of each section."""
    heads = heads.groupBy("head").agg(F.max_by("line", "place").alias("line"))
    count = F.regexp_extract("line", HEAD_RE, 2).cast("long")
    return {row["head"]: row["n"] for row in heads.select("head", count.alias("n")).collect()}
