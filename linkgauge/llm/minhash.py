"""MinHash near-duplicates by fast similarity sketching.

A document's set holds its distinct shingles, as 64-bit hashes. A sketch is filled in rounds: each
throws every shingle into one of ``SIZE`` bins, where it lands with the round and a random fraction, and a bin keeps the least.
After the first round that leaves no bin empty it is done; after ``SIZE`` such rounds one more round for each bin throws all shingles into it,
so every coordinate fills. The share of equal coordinates is an estimate of the similarity, about as sharp as from independent hash functions, at the
cost of a few rounds. Bands of ``ROWS`` coordinates are keys: two sets of similarity 0.8 share none of 40 with a probability
of about 1e-7. Candidates are confirmed on their full sets.

Documents with the same set are one node. Nodes that share a key are a bucket, and what counts is which of its
members are linked, directly or not. So in each round a node outside the largest component of one of its buckets is compared with one node of that component.
Once such rounds link few nodes more, all pairs of a bucket in different components that are left are compared. So copies take about one
comparison each, and no pair of a bucket that could join two components goes unseen. Pairs whose numbers of shingles, or parities of shingles on some bits, show
that they can't be similar aren't compared.

Scale: texts are read once. Buckets are counted, hot ones salted, and so are comparisons of one node with many; sets
go to the comparisons by node, as often as a node has any. Rounds are written to the shared folder.

Defined cases: a null or empty text, or one of blanks, has an empty set and is a component of its own row, with its own id. A text with fewer words than a
shingle has one. Rows with the same id keep a row each. A null id never is a component's id unless the component has no other; it is not kept then.
An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, frugal, join_hot, store
from .components import components

WIDTH = 2
#: Percent of the union that two linked sets share at least.
SIMILAR = 80
#: Coordinates of a sketch, and of a band.
SIZE, ROWS = 200, 5
SEED = 42
#: Words a task remembers the hashes of.
REMEMBERED = 500_000
#: Shingles passed on at a time, and shingles thrown at a time.
FLUSHED, THROWN = 1 << 19, 1 << 14
#: Nodes up to which the table of the texts they are is broadcast (about 50 MB).
BROADCAST_NODES = 1_000_000
#: Members of a bucket, and comparisons of a node, that meet in one task at most.
LIMIT = 1000
#: Rows that a pair counts as where it carries its sets.
SETS = 50
#: When a round links fewer than this part of the nodes, the next one compares all that are left.
FEW = 20
#: Bits that bound from below in how many shingles two sets differ.
PARITIES = 1024
EMPTY = np.uint64(2**64 - 1)

# Multipliers and shifts of a 64-bit finalizer.
MIX = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value

    def trim(self) -> None:
        if len(self) >= REMEMBERED:
            self.clear()


def shingles(text: bytes | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    own = min(width, len(each))
    found = each[: len(each) - own + 1]
    for i in range(1, own):
        found = mixed(found) + each[i : len(each) - own + 1 + i]
    return np.unique(mixed(found + np.uint64(own)))


SEEDS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One number for each coordinate: the round in its upper half, the fraction in its lower one."""
    half = np.uint64(32)
    low = np.uint64((1 << 32) - 1)
    filled = np.full(size, EMPTY)
    step = max(1, THROWN // len(elements))
    for at in range(0, size, step):
        rounds = np.arange(at, min(at + step, size), dtype=np.uint64)
        thrown = mixed(elements[None, :] ^ SEEDS[at : at + len(rounds), None])
        bins = ((thrown >> half) * np.uint64(size) >> half).astype(np.int64)
        np.minimum.at(filled, bins.ravel(), ((thrown & low) + (rounds << half)[:, None]).ravel())
        if (filled != EMPTY).all():
            return filled
    for bin in np.flatnonzero(filled == EMPTY):
        filled[bin] = np.uint64((size + int(bin)) << 32) + (mixed(elements ^ SEEDS[size + bin]) & low).min()
    return filled


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = coordinates.reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        keys = mixed(keys) + bands[:, i]
    return mixed(keys).view(np.int64)


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of ``PARITIES`` bits. Where two sets differ, at least as many shingles are
    in one of them only."""
    odd = np.bincount((elements % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")
    )


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def sketched(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored rows (doc_id, text_key, n_shingles, set_key, bands), one for each document; set_key is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), hashes, width)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands.append(band_keys(sketch(own)) if len(own) else np.empty(0, np.int64))
                hashes.trim()
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(bands)],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
                )

    return store(_rows(documents).mapInArrow(
        frugal(work), "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
    ))


def full_sets(documents: DataFrame, picked: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored rows (node, n, parities, shingles) of the rows (node, doc_id, text_key) of a stored table, from the documents with that id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [pa.array(nodes, pa.int64()), sizes, _lists([parities(s) for s in sets]), _lists(sets)]
            return pa.RecordBatch.from_arrays(columns, ["node", "n", "parities", "shingles"])

        hashes, nodes, sets, held = _Hashes(), [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                nodes.append(node)
                sets.append(shingles(text.as_py(), hashes, width))
                held += len(sets[-1])
                hashes.trim()
                if held >= FLUSHED:
                    yield out()
                    nodes, sets, held = [], [], 0
        if nodes:
            yield out()

    wanted = picked.toDF("node", "of_id", "of_key")
    wanted = F.broadcast(wanted) if picked.count() <= BROADCAST_NODES else wanted
    rows = _rows(documents)
    found = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    return store(found.select("node", "text").mapInArrow(frugal(work), "node long, n long, parities array<long>, shingles array<long>"))


# --------------------------------------------------------------- compare


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.col("salts"))


def _salted(side: DataFrame) -> DataFrame:
    """Rows with ``salts`` once for each salt."""
    return side.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))


def possible(a: str, b: str, similar: int) -> Column:
    """Whether two sets, by their numbers of shingles ``n`` and their parities, may be similar: an exact bound."""
    differing = sum(F.bit_count(F.col(f"parities_{a}")[i].bitwiseXOR(F.col(f"parities_{b}")[i])) for i in range(PARITIES // 64))
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    # with s shingles in all and d in one only, (s - d) / 2 are shared out of (s + d) / 2
    return (100 * F.least(n_a, n_b) >= similar * F.greatest(n_a, n_b)) & (
        (100 + similar) * differing <= (100 - similar) * (n_a + n_b)
    )


def _sized(sets: DataFrame, of: str) -> DataFrame:
    return sets.select("node", F.col("n").alias(f"n_{of}"), F.col("parities").alias(f"parities_{of}"))


def linked(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Stored rows (a, b) of the stored pairs (a, b) whose full sets are similar. ``sets`` has node and shingles."""
    rows = pairs.count() * SETS
    many = few(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LIMIT).alias("salts")), rows)
    many = store(few(many.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a"), rows))
    salts = many.select("a", "salts").where("salts > 1")
    dealt = pairs.join(F.broadcast(salts), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = few(dealt.select("a", "b", _salt("b").alias("salt")).join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    ), rows)
    met = dealt.join(_salted(many), ["a", "salt"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return store(few(met.where(100 * shared >= similar * union).select("a", "b"), rows))


def buckets(nodes: DataFrame) -> DataFrame:
    """Stored rows (key, salts, node) of the keys that several nodes have."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    counts = store(few(counts, nodes.count() * (SIZE // ROWS)))
    sized = counts.withColumn("salts", F.ceil(F.col("copies") / LIMIT))
    return store(join_hot(rows, sized, "key").select("key", "salts", "node"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = members.join(roots, "node", "left")
    return rooted.withColumn("root", F.coalesce("root", "node"))


def _with_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each member with the pivots of its bucket."""
    dealt = members.withColumn("salt", _salt("node"))
    return dealt.join(_salted(pivots).drop("salts"), ["key", "salt"])


def roots_of(members: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Rows (node, root) of the nodes that are linked; root is the least node of the component. ``members`` are those of
    ``buckets``, ``sets`` a stored table of node, n, parities and shingles."""
    members = store(members.join(_sized(sets, "node"), "node"))
    rows = members.count()
    links = tested = store(members.select(F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False)))
    all_at_once, held = False, sets.count()
    while True:
        roots = store(components(links))
        now = store(few(_rooted(members, roots), rows))
        by_root = few(now.groupBy("key", "root").agg(
            F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "n_node", "parities_node")).alias("least")
        ), rows)
        most = store(few(by_root.groupBy("key").agg(
            F.max(F.struct("members", F.col("root").alias("major"), "least")).alias("most"),
            F.count(F.lit(1)).alias("roots"), F.sum("members").alias("copies"),
        ).where("roots > 1").select("key", "most.major", "most.least", "copies"), rows))
        now = store(few(join_hot(now, most.select("key", "major", "copies"), "key"), rows))
        if all_at_once:
            asked = now.where("root <> major").select(
                "key", "salts", F.col("node").alias("pivot"), F.col("n_node").alias("n_pivot"), F.col("root").alias("of"),
                F.col("parities_node").alias("parities_pivot"),
            )
        else:
            asked = few(few(now.select("key", "salts").distinct(), rows).join(most, "key"), rows).select(
                "key", "salts", F.col("least.node").alias("pivot"), F.col("least.n_node").alias("n_pivot"),
                F.col("major").alias("of"), F.col("least.parities_node").alias("parities_pivot"),
            )
        met = _with_pivots(now, asked).where((F.col("root") != F.col("of")) & possible("node", "pivot", similar))
        pairs = met.withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot"))
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if not all_at_once:
            pairs = few(few(pairs, rows).groupBy("node").agg(F.min(F.struct("a", "b")).alias("pair")), rows).select("pair.a", "pair.b")
            new = store(few(pairs.distinct(), rows))
        else:
            new = store(pairs.select("a", "b").distinct())
        found = linked(new, sets, similar)
        links = store(few(links.union(found), rows))
        if all_at_once:
            return components(links)
        tested = store(few(tested.union(new), rows))
        all_at_once = found.count() * FEW <= held


def near_duplicates(documents: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each document."""
    rows = sketched(documents, width)
    sets = rows.where("set_key IS NOT NULL")
    total = rows.count()
    nodes = store(few(sets.groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("pick"),
        F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"),
    ).select("set_key", "pick.doc_id", "pick.text_key", "bands", "copies", F.monotonically_increasing_id().alias("node")), total))
    members = buckets(nodes)
    picked = store(few(nodes.select("node", "doc_id", "text_key").join(few(members.select("node").distinct(), total), "node"), total))
    full = full_sets(documents, picked, width)
    if full.count() > picked.count():  # rows with the same id and text
        full = store(full.dropDuplicates(["node"]))
    roots = roots_of(members, full, similar)
    named = store(few(_rooted(nodes.select("set_key", "node", "doc_id", "copies"), roots), total))
    ids = store(few(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("copies")), total))
    held = store(join_hot(named.select("set_key", "root", F.col("copies").alias("rows")), ids, "root").select(
        "set_key", "component_id", F.col("rows").alias("copies")
    ))
    found = join_hot(sets.select("set_key", "doc_id", "n_shingles"), held, "set_key").select("doc_id", "n_shingles", "component_id")
    none = rows.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.union(none).withColumn("kept", same)
