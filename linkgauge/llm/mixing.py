"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source, targets shared out by weight under a ceiling, and each document is
emitted floor(rate) times, plus once more when a hash of its id, its text and its number among rows that have the same falls
below the fraction.

Scale: the sizes are counted in one pass over the texts. The table of sources is as long as there
are sources; it is broadcast only if it is counted to be short, else joined with
Spark's own means against a hot source.

Defined cases: a null text has no words; null is a source of its own, last in order. A source
without words has target 0 and rate 0, so a document without words is emitted only by the rate
of its source. Rows that repeat, or have no id, draw each for itself; of rows with the same id, text and source it is left open
which has which number. An empty table gives an empty result. Other
columns are carried along by ``mixed`` whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, fresh, store, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Sources up to which their table is broadcast (about 10 MB).
BROADCAST_SOURCES = 100_000
#: Repeated ids up to which their table is broadcast (some 10 MB), and the parts that their rows are numbered in.
BROADCAST_REPEATED, PARTS = 100_000, 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target, rate) from rows (source, size).

    With ceilings c and weights w the targets are min(c, w * level). In the order of c / w,
    the level is that of the first source which doesn't reach its ceiling when all sources before it do.
    """
    sums = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()["total"] * share
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sums.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level", (F.lit(total) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.col("level"))).over(
        Window.partitionBy()
    )
    # the levels after that source are lower, as they count a ceiling that isn't reached
    level = F.coalesce(reached, F.lit(float("inf")))
    return levels.withColumn("target", F.least("ceiling", level * F.col("weight"))).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies_of(keys: list[Column], rate: Column, seed: str = SEED) -> Column:
    """floor(rate) copies, and one more with the probability of the fraction, drawn by a hash of the keys."""
    parts = [key.cast("string") for key in keys]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10)
    draw = draw.cast("long") / F.lit(float(16**13))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def numbered(rows: DataFrame, id: str, digest: str, source: str, number: str) -> DataFrame:
    """Add ``number``, the place of a row, from 0, among those with its id, digest and source.

    Ids seldom repeat, so only rows that do are numbered: first in each of many parts of their group, by a hash of all
    columns, then by how many are in the parts before. So a group of equal rows is never in one task.
    """
    keys = [id, digest, source]
    repeated = store(rows.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)]))
    if repeated.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long"))
    part, place, offset = (fresh(rows, x) for x in ("mix_part", "mix_place", "mix_offset"))
    once = F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATED else repeated
    same = [rows[k].eqNullSafe(once[f"of_{i}"]) for i, k in enumerate(keys)]
    same = same[0] & same[1] & same[2]
    single = rows.join(once, same, "left_anti").withColumn(number, F.lit(0).cast("long"))
    many = rows.join(once, same, "left_semi").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    many = store(many)
    window = Window.partitionBy(part, *keys).orderBy(F.xxhash64(*[c for c in rows.columns]))
    placed = many.withColumn(place, F.row_number().over(window) - 1)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = many.groupBy(part, *keys).count().withColumn(offset, F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(F.col(part).alias("of_part"), offset, *[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)])
    met = (placed[part] == sizes["of_part"]) & placed[id].eqNullSafe(sizes["of_0"]) & placed[digest].eqNullSafe(sizes["of_1"])
    joined = placed.join(sizes, met & placed[source].eqNullSafe(sizes["of_2"]))
    found = joined.withColumn(number, (F.col(place) + F.col(offset)).cast("long")).select(*rows.columns, number)
    return single.unionByName(found)


def with_rates(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Rows with their source's columns of the plan; ``plan`` is a stored table."""
    short = plan.count() <= BROADCAST_SOURCES
    side = plan.withColumnRenamed("source", fresh(rows, "of_source"))
    of = side.columns[0]
    side = F.broadcast(side) if short else side
    return rows.join(side, rows[source].eqNullSafe(side[of])).drop(of)


def sizes_of(documents: DataFrame) -> DataFrame:
    """Stored rows (doc_id, source, size, digest)."""
    return store(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest_of(F.col("text")).alias("digest")))


def mix_plan(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken): the mix without its texts."""
    sizes = sizes_of(documents)
    rows = with_rates(numbered(sizes, "doc_id", "digest", "source", "number"), store(targets(sizes)))
    copies = copies_of([F.col("doc_id"), F.col("digest"), F.col("number")], F.col("rate"), seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    plan = store(targets(documents.select("source", word_count(F.col("text")).alias("size"))))
    rate, copies, copy, digest, number = (fresh(documents, f"mix_{x}") for x in ("rate", "copies", "copy", "digest", "number"))
    rows = numbered(documents.withColumn(digest, digest_of(F.col("text"))), "doc_id", digest, "source", number)
    rows = with_rates(rows, store(plan.select("source", F.col("rate").alias(rate))))
    rows = rows.withColumn(copies, copies_of([F.col("doc_id"), F.col(digest), F.col(number)], F.col(rate), seed))
    return expand(rows, copies, copy).select(*[F.col(f"`{c}`") for c in documents.columns])
