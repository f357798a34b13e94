"""Shards by fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a
map from slot to shard is stored by version: the first version deals the slots, largest
first, to the shard that holds the fewest bytes; a later version moves only the slots that
a shard has too much of, or that new shards need. Records never move between slots.

Scale: the text is read once, to its size and checksum. Everything that goes into one row or is
broadcast is the table of slots, whose length is a parameter. Positions are numbered within
a virtual slot (a ten-thousandth of the rows) and offset per shard, so no task sees a shard.

Defined cases: a null text has no bytes and the checksum of an empty one. Rows with the same id
and text are counted before they are shuffled, then spread over the slots by their number among
their likes. A null id is an id like any other. An empty table gives an empty result and a map of
empty slots. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import expand, store

SLOTS = 4096
#: Bytes that every record counts beside its text.
RECORD_BYTES = 16


def record_sizes(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, virtual_slot), one for each document."""
    digest = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
    )
    alike = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = expand(alike, "copies", "copy")
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots))
    return rows.select("doc_id", "size", "text_crc32", "copy", slot.cast("int").alias("virtual_slot"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows (virtual_slot, bytes, records), one for every slot, also the empty ones."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    held = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    return every.join(held, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records")
    )


def _dealt(slots: DataFrame, loads: Column) -> DataFrame:
    """Rows (virtual_slot, shard): the slots, largest first, each to the least loaded shard.

    ``slots`` has one row: an array of (weight, virtual_slot) and what ``loads`` reads, the weights
    that the shards hold already.
    """
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def give(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        given = F.transform(
            F.array(least), lambda to: F.struct(
                F.transform(state["loads"], lambda v, i: F.when(i == to, v + slot["weight"]).otherwise(v)).alias("loads"),
                F.concat(state["shards"], F.array(to)).alias("shards"),
            )
        )
        return given[0]

    dealt = slots.select("slots", F.aggregate("slots", start, give).alias("state"))
    pairs = F.arrays_zip(F.col("slots.virtual_slot").alias("virtual_slot"), F.col("state.shards").alias("shard"))
    return dealt.select(F.inline(pairs)).toDF("virtual_slot", "shard")


def _in_one_row(slots: DataFrame) -> DataFrame:
    # a slot without bytes weighs a little, so that empty slots are spread too
    weight = F.col("bytes") * SLOTS + 1
    return slots.agg(F.sort_array(F.collect_list(F.struct(weight.alias("weight"), "virtual_slot")), False).alias("slots"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Rows (virtual_slot, shard) of a map made anew."""
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    return _dealt(_in_one_row(sizes), none)


def edited_map(sizes: DataFrame, old: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """The map for ``shards`` shards and today's bytes that moves few slots of the old one.

    A shard keeps its slots, largest first, while they fit into an even share and the
    tolerance; the rest, and the slots of shards that are gone, go to the least loaded shards.
    """
    weight = F.col("bytes") * SLOTS + 1
    share = sizes.agg((F.sum(weight) / shards * (1 + tolerance)).alias("share"))
    so_far = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    placed = (
        sizes.join(F.broadcast(old.select("virtual_slot", "shard")), "virtual_slot")
        .join(F.broadcast(share))
        .withColumn("so_far", F.sum(weight).over(so_far))
        .withColumn("kept", (F.col("so_far") <= F.col("share")) & (F.col("shard") < shards))
    )
    placed = store(placed)
    kept = placed.where("kept")
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = every.join(kept.groupBy("shard").agg(F.sum(weight).alias("load")), "shard", "left").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))),
            lambda x: x["load"],
        ).alias("loads")
    )
    moved = _dealt(_in_one_row(placed.where("NOT kept")).join(held), F.col("loads"))
    return kept.select("virtual_slot", "shard").union(moved)


def write_map(slot_map: DataFrame, folder: str, version: int) -> None:
    slot_map.coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Rows (version, virtual_slot, shard) of one version of the map, else of the last one."""
    versions = spark.read.parquet(folder)
    if version is None:
        version = versions.agg(F.max("version").alias("v")).first()["v"]
    return versions.where(F.col("version") == version)


def place(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with shard and slot, the place within the shard, gapless from 0."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slot_map.join(sizes, "virtual_slot").select(
        "version", "virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    numbered = records.withColumn("n", F.row_number().over(within))
    return numbered.join(F.broadcast(slots), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"),
        "virtual_slot", F.col("version").cast("int").alias("map_version"),
    )
