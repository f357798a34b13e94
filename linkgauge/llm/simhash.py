"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into so few segments that two fingerprints within the
distance agree in one of them but for at most one bit. Each segment is indexed with every one of its bits
wiped out, so equal keys find all such pairs; the distance of each is then computed exactly. Linked
fingerprints are joined to components.

Scale: only distinct fingerprints are indexed, 64 narrow rows each. Keys are dealt out by hash and sorted, and
runs of equal keys are compared in a stream. A run of more than ``LIMIT`` members is cut into blocks
and every pair of its blocks is a run of its own, so no task holds more than two blocks and no pair is lost. A long
run yields a forest, not its pairs: one edge for each member at most. Components are found by alternating
large and small stars, whose rounds are written to the shared folder.

Defined cases: a null or empty text, or one of blanks, has fingerprint 0 and is linked like any other. A text with
fewer words than a shingle is one shingle. Rows with the same id keep a row each. A null id never is
a component's id unless the component has no other. An empty table gives an empty result. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, frugal, store

WIDTH = 4
DISTANCE = 4
SEED = 42
BITS = 64
#: Members of one block of a long run.
LIMIT = 4096
#: Up to this many members the pairs of a run are compared by shifting, and each close pair is an edge.
SHORT = 16
#: Split keys up to which their table is broadcast (some MB).
BROADCAST_KEYS = 200_000
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored rows (doc_id, text_key, fp), one for each document; fp is the signed form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"),
    )
    return store(rows.mapInArrow(frugal(work), "doc_id long, text_key long, fp long"))


# ------------------------------------------------------------------ index


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, bits) of as few segments as leave one of them at most one differing bit."""
    number = distance // 2 + 1
    edges = [round(BITS * i / number) for i in range(number + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _value(fp: Column, offset: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << bits) - 1))


def _key(segment: int, wild: int, value: Column) -> Column:
    """One number for (segment, wiped bit, value without it): below 2**44 for segments up to 32 bits."""
    return value.bitwiseAND(F.lit(~(1 << wild))) + F.lit((segment * BITS + wild) << 32)


def _variants(fp: Column, distance: int) -> Column:
    return F.array(*[
        _key(s, wild, _value(fp, offset, bits))
        for s, (offset, bits) in enumerate(segments(distance)) for wild in range(bits)
    ])


def _split_keys(nodes: DataFrame, distance: int, limit: int) -> DataFrame:
    """Stored rows (key, blocks) of the keys that may have more than ``limit`` members.

    The members of a key have one of two values in its segment, so the values are counted, of
    which there are three for each fingerprint, not the keys.
    """
    cut = segments(distance)
    each = F.array(*[F.struct(F.lit(s).alias("segment"), _value(F.col("fp"), *c).alias("value")) for s, c in enumerate(cut)])
    counts = nodes.select(F.inline(each)).groupBy("segment", "value").count().where(F.col("count") > limit // 2)
    keys = F.lit(None)
    for s, (_, bits) in enumerate(cut):
        keys = F.when(F.col("segment") == s, F.array(*[_key(s, w, F.col("value")) for w in range(bits)])).otherwise(keys)
    members = counts.select(F.explode(keys).alias("key"), "count").groupBy("key").agg(F.sum("count").alias("members"))
    return store(members.select("key", F.ceil((F.col("members") + limit // 2) / limit).cast("int").alias("blocks")))


def index(nodes: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Rows (key, pair, fp): the variants, those of long runs once for each pair of blocks."""
    rows = nodes.select("fp", F.explode(_variants(F.col("fp"), distance)).alias("key"))
    split = _split_keys(nodes, distance, limit)
    number = split.count()
    if not number:
        return rows.select("key", F.lit(0).cast("long").alias("pair"), "fp")
    rows = rows.join(F.broadcast(split) if number <= BROADCAST_KEYS else split, "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks)
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * F.lit(1 << 31) + F.greatest(own, j)
    )
    return rows.select("key", F.explode(pairs).alias("pair"), "fp")


# ---------------------------------------------------------------- compare


def _forest(members: np.ndarray, distance: int, bit: int | None) -> list[tuple[int, int]]:
    """Edges (root, member) that hold together whatever chains of close members hold together.

    With ``bit``, only members that differ in it count as close: the others meet under another key.
    """
    edges, left = [], np.unique(members)
    while len(left):
        if bit is not None and not np.any((left ^ left[0]) >> np.uint64(bit) & np.uint64(1)):
            break
        root, left = left[0], left[1:]
        queue = [root]
        for x in queue:
            differing = left ^ x
            near = np.bitwise_count(differing) <= distance
            if bit is not None:
                near &= (differing >> np.uint64(bit) & np.uint64(1)).astype(bool)
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                edges += [(root, y) for y in found]
    return edges


def _compared(keys: np.ndarray, pairs: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Edges, as an array of two columns, from whole runs of equal (key, pair)."""
    new = np.flatnonzero((keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])) + 1
    starts = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    offsets = np.array([o for o, _ in segments(distance)])
    wild = (keys >> 32) % BITS
    bits = wild + offsets[(keys >> 32) // BITS]
    size = np.repeat(sizes, sizes)
    end = np.repeat(starts + sizes, sizes)
    out = []
    for lag in range(1, SHORT):
        i = np.flatnonzero((size > lag) & (size <= SHORT))
        i = i[i + lag < end[i]]
        if not len(i):
            break
        differing = fps[i] ^ fps[i + lag]
        # equal segments meet under every wiped bit, so they count under the first alone
        own = (wild[i] == 0) | ((differing >> bits[i].astype(np.uint64)) & np.uint64(1)).astype(bool)
        near = i[own & (np.bitwise_count(differing) <= distance)]
        out.append(np.stack([fps[near], fps[near + lag]], axis=1))
    for run in np.flatnonzero(sizes > SHORT):
        at = starts[run]
        edges = _forest(fps[at : at + sizes[run]], distance, None if wild[at] == 0 else int(bits[at]))
        if edges:
            out.append(np.array(edges, np.uint64))
    found = np.concatenate(out) if out else np.empty((0, 2), np.uint64)
    return np.unique(found, axis=0) if len(found) else found


def edges(nodes: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Stored rows (a, b) of fingerprints whose chains of links are those of all pairs within the distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edge_batch(found: np.ndarray) -> pa.RecordBatch:
            signed = np.ascontiguousarray(found.T).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[0]), pa.array(signed[1])], ["a", "b"])

        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            own[2] = own[2].view(np.uint64)
            keys, pairs, fps = (np.concatenate((r, o)) for r, o in zip(rest, own))
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]) | (pairs != pairs[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield edge_batch(_compared(keys[:cut], pairs[:cut], fps[:cut], distance))
            rest = [keys[cut:], pairs[cut:], fps[cut:]]
        if len(rest[0]):
            yield edge_batch(_compared(*rest, distance))

    dealt = index(nodes, distance, limit).repartition("key", "pair").sortWithinPartitions("key", "pair")
    return store(dealt.mapInArrow(frugal(work), "a long, b long").distinct())


# ------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes with a link; root is the least node of the component.

    Every round joins the greater neighbours of each node to its least neighbour, then the lesser
    ones, until nothing changes; the rounds grow with the logarithm of a component's size.
    """
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = store(small.distinct())


def classes(rows: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, text_key, fp, root, component_id) from stored fingerprints; root is the component's least fp."""
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(edges(nodes, distance, limit)).withColumnRenamed("node", "fp")
    held = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = held.groupBy("root").agg(F.min("first").alias("component_id"))
    named = store(held.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, text_key, fp, root, component_id), one for each document."""
    return classes(fingerprints(documents, width), distance)


def deduplicated(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """The documents with their own columns, one row of each component: the one with the least id.

    Of rows with that same id, the one with the least text key stays.
    """
    rows = near_duplicates(documents, width, distance)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "fp")
    kept = store(rows.groupBy("root").agg(F.min(order).alias("row")).select("row.doc_id", "row.text_key"))
    repeated = rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    key, of = fresh(documents, "text_key"), [fresh(documents, x) for x in ("kept_id", "kept_key")]
    keyed = documents.withColumn(key, F.xxhash64("text"))
    kept = kept.toDF(*of)
    stay = keyed["doc_id"].cast("long").eqNullSafe(kept[of[0]]) & (keyed[key] == kept[of[1]])
    left = keyed.join(kept, stay, "left_semi")
    left = left.dropDuplicates(["doc_id", key]) if repeated else left
    return left.select(*[F.col(f"`{c}`") for c in documents.columns])
