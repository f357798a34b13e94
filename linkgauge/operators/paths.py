"""Shortest paths by number of links, and betweenness built on them.

The searches carry one row per source and node it reaches. Both are numbered for
the searches, since such rows outnumber nodes and links by far; results get the
graph's own ids back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import or_zero
from ..plans.ledger import Attempt, Ledger
from ..plans.loop import checkpoint, discard, dropped, few_rows, fixed_layout, hashed, new_table, partitions_for, shuffles_dropped, store
from ..schema import Graph
from ..sources.tables import checked
from . import blocks, whole
from .folding import Folded, fold
from .layout import LinksByEnd, join_per_end, links_by_end
from .positions import with_position

# A batch of sources holds about this many rows of state, sources times nodes, for
# each task the cluster runs at once. Callers may give a number of rows themselves.
BATCH_ROWS_PER_TASK = 25_000_000

# Chosen sources up to which their ids are broadcast when results get their ids back.
BROADCAST_SOURCES = 1_000_000

# State rows are a few numbers, and rows that meet links are summed up on the spot,
# so a partition takes more of them than of nodes or links.
STATE_ROWS_PER_PARTITION = 2_000_000
MET_ROWS_PER_PARTITION = 5_000_000

# After this many levels the nodes visited so far are rewritten as one table.
LEVELS_PER_TABLE = 16

# Tasks of a level searched in blocks at most.
MOST_TASKS = 20_000

# Names of batches in a ledger begin with this; the columns of what they find there.
BATCH = "batch-"
SCORES = "key long, score double, square double, reach double, come double"


def shortest_paths(
    graph: Graph, sources: DataFrame | None = None, batch_rows: int | None = None, partitions: int | None = None,
    all_sources: bool = False,
) -> DataFrame:
    """source, id, dist, sigma: for every node a source reaches, the number of links on
    a shortest path and the number of such paths. A source reaches itself at 0.

    The result has up to sources times nodes rows, so paths from every node have to be
    asked for by ``all_sources``.
    """
    if sources is None and not all_sources:
        raise ValueError("give sources, or all_sources=True for paths from every node")
    searches = _Searches(graph, sources, batch_rows, partitions)
    for batch in searches.batches():
        with searches.ledger.step(batch.step) as attempt:
            for at in range(0, len(batch.levels), LEVELS_PER_TABLE):
                attempt.add(reduce(DataFrame.union, [
                    level.selectExpr("source", "id", f"{dist} AS dist", "sigma")
                    for dist, level in enumerate(batch.levels[at : at + LEVELS_PER_TABLE], at)
                ]))
    found = searches.ledger.read("source long, id long, dist int, sigma double", BATCH)
    return searches.with_ids(found, "source", "id").select("source", "id", "dist", "sigma")


def touched_nodes(
    graph: Graph, sources: DataFrame | None = None, batch_rows: int | None = None, partitions: int | None = None
) -> int:
    """How many nodes all sources together reach, themselves included. What hangs on one neighbour is counted in
    closed form, as in ``betweenness``."""
    searches = _Searches(graph, sources, batch_rows, partitions)
    folded = searches.fold()
    for batch in searches.blocks(scored=False):
        with searches.ledger.step(batch.step) as attempt:
            batch.add_ends(attempt)
    found = searches.ledger.read(SCORES, BATCH).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("score", "reach", "come")])
    reached = F.sum((F.col("own") * F.col("reach")).cast("decimal(38,0)"))
    return int(folded.unfolded(found).agg(reached.alias("n")).first()["n"] or 0)


def betweenness(
    graph: Graph, sources: DataFrame | None = None, batch_rows: int | None = None, partitions: int | None = None,
    job: str | None = None,
) -> DataFrame:
    """id, betweenness: over all ordered pairs of other nodes, the share of their
    shortest paths that pass through a node. Directed, link weights ignored, not
    normalised, end points excluded.

    What hangs on one neighbour is taken off first and counted in closed form (see ``folding``);
    all sources together visit nodes times links of the core that is left. ``sources`` (a table with id)
    restricts the sum to paths from those; the result is then partial.

    ``job`` names a run. If its driver is lost, another one given the same name, graph and sources searches only the
    batches that are not in the job's ledger yet.
    """
    searches = _Searches(graph, sources, batch_rows, partitions, job)
    folded = searches.fold()
    for batch in searches.blocks():
        with searches.ledger.step(batch.step) as attempt:
            batch.add_scores(attempt)
            if folded.rounds:
                batch.add_ends(attempt)
    found = searches.ledger.read(SCORES, BATCH).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("score", "reach", "come")]
    )
    total = folded.unfolded(found).withColumnRenamed("key", "id")
    nodes = graph.vertices.select("id")
    scored = nodes.join(searches.with_ids(total, "id"), "id", "left")
    return scored.select("id", or_zero(F.col("score")).alias("betweenness"))


class _Blocks(NamedTuple):
    """Nodes by place, and links packed by the blocks of their ends, there and back."""

    places: DataFrame
    targets: DataFrame
    forward: DataFrame
    backward: DataFrame
    count: int
    size: int
    width: int


class _Batch:
    """Sources whose searches run together, level by level, in blocks (see ``blocks``). A source stands for ``s``
    sources, a node for ``t`` targets.

    levels  per distance one table of cells and numbers of paths
    step    the batch's name in the job's ledger
    """

    def __init__(self, step: str, sources: DataFrame, graph: _Blocks, count: int):
        self.step, self.graph, self.tables, self.levels, self.touched = step, graph, [], [], 0
        size, width = graph.size, graph.width
        self.sources = store(
            with_position(sources.select("key", "s"), [F.col("key")], "place").withColumn("place", F.col("place") - 1)
        )
        groups = -(-count // width)
        self.partitions = max(1, min(groups * graph.count, MOST_TASKS))
        of = f"cast(place div {width} AS int) AS g"
        self.given = store(blocks.packed(self.sources.selectExpr(of, "place", "s"), ["g"], "place", s="float64"))
        self.given = store(self.given.select("g", F.expr(f"rpad(s, {8 * width}, X'00')").alias("s")))
        at = self.sources.selectExpr("key", of, f"place % {width} AS col").join(graph.places, "key")
        cells = at.selectExpr("g", f"cast(place div {size} AS int) AS b", f"place % {size} * {width} + col AS cells")
        starts = store(blocks.packed(cells, ["g", "b"], "cells", cells="int32"))
        every = self.given.select("g").crossJoin(graph.targets.select("b")).join(starts, ["g", "b"], "left")
        own = every.selectExpr("g", "b", "cast(NULL AS binary) AS x", "coalesce(cells, X'') AS y")
        kernel, arriving = blocks.found(size, width), None
        while True:
            level = self._written(own, graph.forward, arriving, kernel, blocks.LEVEL)
            rows = level.agg(F.sum("n").alias("n")).first()["n"] or 0
            if not rows:
                return
            self.touched += rows
            self.levels.append(level)
            own = level.selectExpr("g", "b", "visited AS x", "cast(NULL AS binary) AS y")
            arriving = level.where("n > 0").selectExpr("g", "b AS part", "cells AS x", "sigma AS y")

    def _written(self, own: DataFrame, links: DataFrame, arriving: DataFrame | None, kernel, schema: str) -> DataFrame:
        spark = own.sparkSession
        path = new_table(spark)
        graph = self.graph
        met = blocks.meet(own, links, arriving, graph.targets, self.given, kernel, schema, self.partitions, graph.count)
        with few_rows(spark), shuffles_dropped(spark):
            met.write.parquet(path)
        self.tables.append(path)
        return spark.read.schema(schema).parquet(path)

    def add_scores(self, table: Attempt) -> None:
        """Add key, score, square, from the deepest level back to the first.

        With sigma paths to a node, delta its dependency and t the targets it stands for, a node gains
        ``sigma * sum((t + delta) / sigma)`` over its successors on shortest paths, and scores that
        for each of the s sources that the search stands for; square sums the squares of these.
        """
        graph, arriving, scored = self.graph, None, []
        kernel = blocks.depended(graph.size, graph.width)
        if len(self.levels) < 3:
            return
        for depth in range(len(self.levels) - 1, 0, -1):
            own = self.levels[depth].where("n > 0").selectExpr("g", "b", "cells AS x", "sigma AS y")
            back = self._written(own, graph.backward, arriving, kernel, blocks.BACK)
            arriving = back.selectExpr("g", "b AS part", "cells AS x", "quotient AS y")
            scored.append(back)
            if len(scored) == LEVELS_PER_TABLE or depth == 1:
                rows = blocks.unpacked(reduce(DataFrame.union, scored), "b", graph.size, "score", "square")
                sums = rows.groupBy("place").agg(F.sum("score").alias("score"), F.sum("square").alias("square"))
                with few_rows(graph.places.sparkSession):
                    table.add(sums.join(graph.places, "place").selectExpr("key", "score", "square", "0D AS reach", "0D AS come"))
                scored = []

    def add_ends(self, table: Attempt) -> None:
        """Add key, reach of the batch's sources, and key, come of the nodes they reach."""
        for at in range(0, len(self.levels), LEVELS_PER_TABLE):
            rows = reduce(DataFrame.union, self.levels[at : at + LEVELS_PER_TABLE])
            reach = blocks.unpacked(rows, "g", self.graph.width, "reach").groupBy("place").agg(F.sum("reach").alias("reach"))
            reach = reach.join(self.sources, "place")
            come = blocks.unpacked(rows, "b", self.graph.size, "come").groupBy("place").agg(F.sum("come").alias("come"))
            come = come.join(self.graph.places, "place")
            with few_rows(rows.sparkSession):
                table.add(reach.selectExpr("key", "0D AS score", "0D AS square", "reach", "0D AS come"))
                table.add(come.selectExpr("key", "0D AS score", "0D AS square", "0D AS reach", "come"))

    def close(self) -> None:
        for path in self.tables:
            dropped(self.sources.sparkSession, path)


class _Links(NamedTuple):
    """Nodes by place, and all links packed in rows, for tasks that take them whole."""

    places: DataFrame
    rows: DataFrame
    nodes: int
    scored: bool
    shared: bool


class _Whole(_Batch):
    """Sources whose searches run together, some in each task, from the first level to the last and back (see ``whole``)."""

    def __init__(self, step: str, sources: DataFrame, graph: _Links):
        self.step, self.sources, self.graph, self.tables, self.touched = step, sources, graph, [], 0
        spark = sources.sparkSession
        own = store(sources.select("root").distinct())
        tasks = whole.tasks_for(own.count(), spark.sparkContext.defaultParallelism)
        dealt = with_position(own, [F.col("root")], "row").selectExpr("root", f"cast(row % {tasks} AS int) AS g")
        rows = sources.join(dealt, "root").select("g", "place", "s")
        given = store(blocks.packed(rows, ["g"], "place", place="int32", s="float64"))
        found = whole.meet(given, graph.rows, tasks, graph.nodes, graph.scored, graph.shared)
        path = new_table(spark)
        with few_rows(spark), shuffles_dropped(spark):
            found.write.parquet(path)
        self.tables.append(path)
        found = spark.read.schema(found.schema).parquet(path)
        self.touched = found.agg(F.sum("touched").alias("n")).first()["n"] or 0
        self.found = found.join(graph.places, "place")

    def add_scores(self, table: Attempt) -> None:
        table.add(self.found.where("score != 0").selectExpr("key", "score", "square", "0D AS reach", "0D AS come"))

    def add_ends(self, table: Attempt) -> None:
        table.add(self.found.selectExpr("key", "0D AS score", "0D AS square", "reach", "come"))


class _Levels:
    """Sources whose searches run together, level by level.

    levels  per distance one table of source, id, sigma, hashed by the first two
    rows    how many rows each of them has
    step    the batch's name in the job's ledger
    """

    def __init__(self, step: str, sources: DataFrame, forward: LinksByEnd, partitions: int):
        self.step = step
        self.others: list[DataFrame] = []
        frontier, rows = _counted(
            sources.selectExpr("key AS source", "key AS id", "1D AS sigma").repartition(partitions, "source", "id")
        )
        self.levels, self.rows, visited = [frontier], [rows], frontier.select("source", "id")
        while rows:
            found = (
                forward.meet(frontier.selectExpr("source", "id AS src", "sigma"), rows)
                .groupBy("source", F.col("dst").alias("id"))
                .agg(F.expr("sum(sigma) AS sigma"))
            )
            seen = hashed(visited, self.touched, partitions)
            frontier, rows = _counted(found.join(seen, ["source", "id"], "left_anti"))
            if not rows:
                discard(frontier)
                return
            self.levels.append(frontier)
            self.rows.append(rows)
            visited = visited.union(frontier.select("source", "id"))
            if len(self.levels) % LEVELS_PER_TABLE == 0:
                visited = checkpoint(visited.repartition(partitions, "source", "id"))
                self.others.append(visited)

    @property
    def touched(self) -> int:
        return sum(self.rows)

    def close(self) -> None:
        for frame in [*self.levels, *self.others]:
            discard(frame)


def _counted(frame: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    frame = checkpoint(frame.observe(seen, F.expr("count(*) AS rows")))
    return frame, seen.get["rows"]


def batches_for(sources: int, nodes: int, batch_rows: int) -> int:
    """Batches of sources: as many as hold ``batch_rows`` rows each, never more than sources."""
    return max(1, min(sources, math.ceil(sources * nodes / batch_rows)))


class _Searches:
    """All searches over one graph: numbered nodes and links, sources in batches."""

    def __init__(
        self, graph: Graph, sources: DataFrame | None, batch_rows: int | None, partitions: int | None,
        job: str | None = None,
    ):
        graph = checked(graph)
        self.spark = graph.vertices.sparkSession
        self.ledger = Ledger(self.spark, job)
        self.ledger.belongs_to(
            nodes=graph.vertices.select("id"), links=graph.edges.select("src", "dst"),
            **({} if sources is None else {"sources": sources.select("id")}),
        )
        header = graph.header.first()
        nodes, links = header["num_node"], header["link_lines"]
        self.given_rows = batch_rows
        self.batch_rows = batch_rows or BATCH_ROWS_PER_TASK * self.spark.sparkContext.defaultParallelism
        self.given_partitions = partitions
        self.numbers = self.ledger.table("numbers", lambda: _numbers(graph.vertices)) if job else _numbers(graph.vertices)
        self.proper = _numbered(graph.edges.where(F.col("src") != F.col("dst")).select("src", "dst"), self.numbers)
        chosen = self.numbers if sources is None else self.numbers.join(sources.select("id"), "id", "left_semi")
        self.sources, self.all_sources = store(chosen) if sources is not None else chosen, sources is None
        self.count = nodes if sources is None else self.sources.count()
        self.starts, self.nodes = self.sources.select("key"), self.numbers.select("key", F.lit(1.0).alias("t"))
        self._size(self.count, nodes, links)

    def _size(self, starts: int, nodes: int, links: int) -> None:
        self.links, self.number = links, batches_for(starts, nodes, self.batch_rows)
        self.start_count, self.node_count = starts, nodes
        self.partitions = self.given_partitions or max(
            partitions_for(links),
            partitions_for(starts * nodes // self.number, STATE_ROWS_PER_PARTITION),
            partitions_for(starts * links // self.number, MET_ROWS_PER_PARTITION),
        )

    def fold(self) -> Folded:
        """Search the core of the folded graph from now on."""
        own = self.numbers.select("key", F.lit(1.0).alias("own"))
        if not self.all_sources:
            chosen = self.sources.select("key", F.lit(1.0).alias("chosen"))
            own = own.join(chosen, "key", "left").select("key", F.coalesce("chosen", F.lit(0.0)).alias("own"))
        folded = fold(own, self.proper)
        self.starts = store(folded.core.where("s > 0").select("key", "s"))
        self.nodes, self.proper = folded.core.select("key", "t"), folded.links
        self._size(self.starts.count(), folded.nodes, self.proper.count())
        return folded

    def batches(self) -> Iterator[_Levels]:
        """Batches split by hash, so no list of sources passes through the driver; those in the ledger are left out.

        The session keeps the settings of the fixed layout until the last batch is done,
        or the generator is closed.
        """
        with fixed_layout(self.spark, self.partitions), ExitStack() as stack:
            forward = links_by_end(self.proper, "src", self.links, self.partitions)
            stack.callback(forward.release)
            yield from self._each(BATCH, self.starts, "key", lambda step, chosen: _Levels(step, chosen, forward, self.partitions))

    def blocks(self, name: str = BATCH, scored: bool = True, squared: bool = False) -> Iterator[_Batch]:
        """Such batches for scores and ends, or for ends alone, searched in tasks that take all links if those fit and no number of
        partitions is given, else in blocks. Squares may be left at 0 unless they are asked for."""
        cores = self.spark.sparkContext.defaultParallelism
        takes_all = self.given_partitions is None and whole.fits(self.node_count, self.links)
        if self.ledger.named:  # sources go to batches in another way then, so a later driver does as the first one
            takes_all = self.ledger.note(f"{name}whole", lambda: takes_all and f"{name}number" not in self.ledger.entries())
        if takes_all:
            yield from self._whole(name, scored, not squared, cores)
            return
        each = -(-self.start_count // self.number)
        count, size, width = blocks.shape(self.node_count, self.links, each, cores, self.given_partitions)
        with fixed_layout(self.spark, max(count * count, min(partitions_for(self.links), 4 * cores))):
            if not self.start_count:
                return
            of = f"cast(place div {size} AS int)"
            places, links = self._placed()
            targets = blocks.packed(places.selectExpr(f"{of} AS b", "place", "cast(t AS double) AS t"), ["b"], "place", t="float64")
            targets = store(targets.select("b", F.expr(f"rpad(t, {8 * size}, X'00')").alias("t")))
            ends = {e: (f"cast({e} div {size} AS int)", f"{e} % {size}") for e in ("src", "dst")}

            def packed(start: str, end: str) -> DataFrame:
                (part, come_from), (b, to) = ends[start], ends[end]
                rows = links.selectExpr(f"{part} AS part", f"{b} AS b", f"{come_from} AS come_from", f"{to} AS to")
                return store(blocks.packed(rows, ["part", "b"], "to", come_from="uint16", to="uint16"))

            graph = _Blocks(
                places.select("key", "place"), targets, packed("src", "dst"), packed("dst", "src"), count, size, width
            )
            yield from self._each(name, self.starts, "key", lambda step, chosen: _Batch(step, chosen, graph, chosen.count()))

    def _whole(self, name: str, scored: bool, shared: bool, cores: int) -> Iterator[_Batch]:
        nodes, size = self.node_count, whole.row_size(self.node_count, self.links)
        with fixed_layout(self.spark, min(partitions_for(max(self.links, whole.TASKS_PER_CORE * nodes)), 4 * cores)):
            if not self.start_count:
                return
            places, links = self._placed()
            targets = blocks.packed(
                places.selectExpr(f"cast(place div {size} AS int) AS part", "place", "cast(t AS double) AS t"), ["part"], "place", t="float64"
            )
            rows = links.selectExpr(f"cast(src div {size} AS int) AS part", "src AS come_from", "dst AS to")
            rows = blocks.packed(rows, ["part"], "come_from", come_from="int32", to="int32")
            rows = store(targets.join(rows, "part", "left").selectExpr("part", "t", "coalesce(come_from, X'') AS come_from", "coalesce(to, X'') AS to"))
            starts = self.starts.join(places.select("key", "place"), "key").select("place", "s")
            if shared:
                with few_rows(self.spark):
                    starts = store(starts.join(whole.all_roots(rows, nodes), "place"))
            else:
                starts = store(starts.withColumn("root", F.col("place")))
            if self.given_rows is None:
                work = starts.select("root").distinct().count()
                self.number = batches_for(work, nodes + self.links, whole.BATCH_WORK * cores)
            graph = _Links(places.select("key", "place"), rows, nodes, scored, shared)
            yield from self._each(name, starts, "root", lambda step, chosen: _Whole(step, chosen, graph))

    def _placed(self) -> tuple[DataFrame, DataFrame]:
        """Nodes with a place from 0 on, and links between places."""
        places = with_position(self.nodes, [F.col("key")], "place")
        places = store(places.withColumn("place", F.col("place") - 1))
        return places, _numbered(self.proper.select("src", "dst"), places.selectExpr("key AS id", "place AS key"))

    def _each(self, name: str, starts: DataFrame, by: str, search: Callable) -> Iterator:
        # a later driver may have other resources, yet its batches are those of the first
        number, finished = self.number, {}
        if self.ledger.named:
            number = self.ledger.note(f"{name}number", lambda: self.number)
            finished = self.ledger.entries()
        for index in range(number):
            if f"{name}{index}" in finished:
                continue
            chosen = starts
            if number > 1:
                chosen = chosen.where(F.pmod(F.xxhash64(by), F.lit(number)) == index)
            batch = search(f"{name}{index}", chosen)
            try:
                if batch.touched:
                    yield batch
            finally:
                batch.close()

    def with_ids(self, frame: DataFrame, *columns: str) -> DataFrame:
        """Replace numbers by the ids they stand for.

        All rows of a source share its number. Chosen sources are few, so their ids come by broadcast;
        all sources together are no hot key.
        """
        for column in columns:
            numbers = self.sources if column == "source" else self.numbers
            ids = numbers.select(F.col("key").alias(column), F.col("id").alias("_id"))
            if column == "source" and not self.all_sources and self.count <= BROADCAST_SOURCES:
                ids = F.broadcast(ids)
            others = [c for c in frame.columns if c != column]
            frame = frame.join(ids, column).select(F.col("_id").alias(column), *others)
        return frame


def _numbers(vertices: DataFrame) -> DataFrame:
    """id, key: a number for every node; ids that are numbers stand for themselves."""
    if isinstance(vertices.schema["id"].dataType, T.IntegralType):
        return vertices.select("id", F.col("id").cast("long").alias("key"))
    return store(vertices.select("id", F.monotonically_increasing_id().alias("key")))


def _numbered(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs of numbers for pairs of ids, hubs treated at either end."""
    for end in ("src", "dst"):
        links = pairs.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("links"))
        per_end = links.join(numbers, "id").select(F.col("id").alias(end), "links", "key")
        other = "dst" if end == "src" else "src"
        pairs = join_per_end(pairs, per_end, end).select(F.col("key").alias(end), other)
    return store(pairs)
