"""Language-model scores by prediction by partial matching, beside a base score of words.

The model is a trie of byte contexts: counts of every byte after its three, two, one and no bytes before. A byte
that its context hasn't seen is reached by escapes: the escape of a context is estimated from its
distinct bytes (method C), and bytes that the longer context knows are excluded from the shorter ones.
A text is framed by byte 255, which UTF-8 never uses, so that beginnings and ends are predicted too. The model is
pretrained on the training rows; the code length of a text is the sum over its bytes, in lower case.

Scale: counts of contexts and of words are gathered from all training texts, summed in tasks first, and all of them are used. What tasks look
up is bounded whatever the corpus: a row for each of the at most 65,536 contexts of two bytes, and for each context of three bytes that
comes before at least one in ``NODES`` of all bytes, of which there are at most ``NODES``. A row has 256 numbers of four bytes, which makes 128 MB
at the very most. A bitmap of 2 MB tells which other contexts of three bytes the training texts have. Their bytes are counted for each document and
meet their probabilities, worked out once for each context with its next byte, in a join. Words go the same way: the ``FREQUENT`` most
frequent ones go with the table, which also takes the hot keys, and all others meet their counts in a join.

Defined cases: a null text is empty; it has an end to predict, and one token. A null id is held out. Rows with the same id are
scored each. Without training rows every byte has probability 1/256 and the base score is 0. Words are known by
64-bit hashes. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, store

ADDED = 0.1
#: Of so many remainders of the id's checksum the first is held out.
FOLDS = 10
FRAME = bytes([255])
ORDER = 3
#: Contexts of three bytes that tasks look up at most; the others are joined, so this doesn't change any score.
NODES = 1 << 16
CONTEXTS = 1 << 24
#: Words that tasks look up at most; about 3 MB.
FREQUENT = 200_000
#: Words that a task counts, or remembers, before it passes them on.
REMEMBERED = 500_000
#: Bytes that are looked up, or counted, at a time.
SLICE = 1 << 21
#: Contexts with their next byte that a task holds counts of before it passes them on.
HELD = 2_000_000
WORD_COUNT, GRAM_COUNT, TEXT_COUNT = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == 0


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )


def _slices(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context of three bytes, next byte) for all bytes of a text and its end."""
    framed = np.frombuffer(FRAME * ORDER + text + FRAME, np.uint8)
    for at in range(0, len(framed) - ORDER, SLICE):
        part = framed[at : at + SLICE + ORDER]
        yield part[:-3].astype(np.uint32) << 16 | part[1:-2].astype(np.uint32) << 8 | part[2:-1], part[3:]


# ------------------------------------------------------------------- train


class _Grams:
    """Counts of contexts with their next byte, kept sparse."""

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for context, after in _slices(text):
            self.waiting.append(context << 8 | after)
            self.size += len(after)
            if self.size >= SLICE:
                self.fold()

    def fold(self) -> None:
        if self.size:
            keys, found = np.unique(np.concatenate(self.waiting), return_counts=True)
            every, place = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
            counts = np.zeros(len(every), np.int64)
            np.add.at(counts, place, np.concatenate((self.counts, found)))
            self.keys, self.counts, self.waiting, self.size = every, counts, [], 0

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.keys.astype(np.int64), self.counts
        self.__init__()
        return out


def corpus_counts(documents: DataFrame) -> DataFrame:
    """Stored rows (kind, key, n) of the training texts: words by hash, bytes with three before, and texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"]
            )

        def words_out() -> pa.RecordBatch:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            return out(WORD_COUNT, keys.view(np.int64), np.fromiter(words.values(), np.int64, len(words)))

        words: Counter[bytes] = Counter()
        grams, texts = _Grams(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lowered = text.lower()
                words.update(lowered.split())
                grams.add(lowered)
                texts += 1
                if len(words) >= REMEMBERED:
                    yield words_out()
                    words.clear()
                if len(grams.keys) >= HELD:
                    yield out(GRAM_COUNT, *grams.taken())
        yield words_out()
        yield out(GRAM_COUNT, *grams.taken())
        yield out(TEXT_COUNT, np.zeros(1, np.int64), np.array([texts], np.int64))

    training = _rows(documents).where("NOT held_out").select("text")
    found = training.mapInArrow(frugal(work), "kind int, key long, n long")
    return store(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _level(seen: np.ndarray, mass: np.ndarray, left: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One level of the trie: fills ``seen`` with the probabilities of bytes that ``counts`` knows and that are
    not yet filled, and returns what probability is left for the others. One row for each context."""
    open_counts = np.where(left, counts, 0)
    total = open_counts.sum(axis=1, keepdims=True).astype(np.float64)
    kinds = (open_counts > 0).sum(axis=1, keepdims=True)
    share = mass / np.maximum(total + kinds, 1)
    np.copyto(seen, open_counts * share, where=open_counts > 0)
    left &= open_counts == 0
    return np.where(kinds > 0, kinds * share, mass)


def _dense(context: np.ndarray, after: np.ndarray, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A row of 256 counts for each of the known contexts."""
    place = np.searchsorted(known, context)
    return np.bincount(place * 256 + after, counts, len(known) * 256).reshape(-1, 256)


def _filled(levels: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of all bytes, by the counts of ever shorter contexts. One row for each context."""
    rows = len(levels[0])
    p, left, mass = np.zeros((rows, 256)), np.ones((rows, 256), bool), np.ones((rows, 1))
    for level in levels:
        mass = _level(p, mass, left, level)
    rest = left.sum(axis=1, keepdims=True)
    np.copyto(p, mass / np.maximum(rest, 1), where=left)
    return np.log10(p)


def _below(contexts: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The levels under contexts of two bytes: that of their last byte, and that of no context."""
    return [last[contexts & 255], np.broadcast_to(last.sum(axis=0, keepdims=True), (len(contexts), 256))]


Counts = tuple[np.ndarray, np.ndarray]


def last_counts(two: Counts) -> np.ndarray:
    """Counts of the next byte by the last one alone, from those by the last two."""
    return np.bincount(two[0] & 65535, two[1], 65536).reshape(256, 256)


def trie_table(three: Counts, two: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts of three bytes, contexts of two bytes, log10 probabilities of the next byte).

    Both come as (context << 8 | next byte, count), sorted. The table has a row for each context of three, then for each of two,
    for each last byte, and one of zeros for contexts whose bytes are joined.
    """
    context3, context2 = three[0] >> 8, two[0] >> 8
    known3, known2 = np.unique(context3), np.unique(context2)
    last = last_counts(two)

    def part_of(counts: Counts, context: np.ndarray, known: np.ndarray) -> np.ndarray:
        at, to = np.searchsorted(context, [known[0], known[-1] + 1])
        own = np.isin(context[at:to], known)
        return _dense(context[at:to][own], (counts[0][at:to] & 255)[own], counts[1][at:to][own], known)

    tables = []
    for at in range(0, len(known3), 2048):
        known = known3[at : at + 2048]
        ends, place = np.unique(known & 65535, return_inverse=True)
        tables.append(_filled([
            part_of(three, context3, known), part_of(two, context2, ends)[place], *_below(known, last)
        ]))
    for at in range(0, len(known2), 2048):
        known = known2[at : at + 2048]
        tables.append(_filled([part_of(two, context2, known), *_below(known, last)]))
    tables += [_filled(_below(np.arange(256), last))]
    tables.append(np.zeros((1, 256)))
    return known3, known2, np.concatenate(tables).astype(np.float32)


def joined_row(known3: np.ndarray, known2: np.ndarray) -> int:
    return len(known3) + len(known2) + 256


def row_numbers(known3: np.ndarray, known2: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The row of the table for every context of three bytes: that of its longest known ending, or the last if its bytes are joined.

    ``joined`` has a bit for each context.
    """
    of_two = len(known3) + len(known2) + np.arange(1 << 16, dtype=np.int32) % 256
    of_two[known2] = len(known3) + np.arange(len(known2))
    rows = np.tile(of_two, 256).astype(np.int32)
    rows[np.unpackbits(joined, bitorder="little").view(bool)] = joined_row(known3, known2)
    rows[known3] = np.arange(len(known3))
    return rows


def _bitmap(contexts: DataFrame) -> np.ndarray:
    """A bit for each context of three bytes: whether the table, one row for each context, has it."""
    number = F.col("context") + 1  # Spark's bitmaps count from 1
    parts = contexts.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros(CONTEXTS // 8, np.uint8)
    for r in parts.collect():  # at most 512 parts of 4 KB
        bits = np.frombuffer(r["bits"], np.uint8)
        at = (r["part"] - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return out


def _next_bytes(counts: DataFrame, name: str) -> DataFrame:
    """One row for each context, with the bytes after it, at most 256, and their counts in ``name``, from rows (context, key, n)."""
    own = F.struct(F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    return counts.groupBy("context").agg(F.collect_list(own).alias(name))


def trie_counts(counts: DataFrame) -> tuple[Counts, Counts, DataFrame, DataFrame]:
    """From rows (key, n): counts of the contexts of three bytes that are looked up, and of all of two; then as tables
    (context, three) all other contexts of three with the counts of their next bytes, stored, and (ending, two) those of two."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    keyed = counts.withColumn("context", F.shiftright("key", 8))
    looked_up = F.col("all") * NODES >= total
    nodes = keyed.groupBy("context").agg(F.sum("n").alias("all"))
    three = keyed.join(nodes.where(looked_up), "context").select("key", "n")
    others = store(_next_bytes(keyed.join(nodes.where(~looked_up).drop("all"), "context"), "three"))
    two = counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("n").alias("n"))
    endings = _next_bytes(two.withColumn("context", F.shiftright("key", 8)), "two").withColumnRenamed("context", "ending")

    def sorted_rows(frame: DataFrame) -> Counts:
        found = frame.toArrow()
        keys, n = (found.column(i).to_numpy() for i in range(2))
        order = np.argsort(keys)
        return keys[order], n[order]

    return sorted_rows(three), sorted_rows(two), others, endings


def _rows_of_counts(column: pa.Array) -> np.ndarray:
    """A row of 256 counts for each list of (byte, n)."""
    pairs = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    place = np.repeat(np.arange(len(column)), lengths) * 256 + pairs.field("byte").to_numpy()
    return np.bincount(place, pairs.field("n").to_numpy(), len(column) * 256).reshape(-1, 256)


def joined_chances(keys: DataFrame, others: DataFrame, endings: DataFrame, last: np.ndarray) -> DataFrame:
    """Rows (key, chance): log10 probabilities of the contexts of three bytes with their next byte that ``keys`` lists once or more.

    A context has at most 256 next bytes, and an ending of two bytes is that of at most 256 contexts, so no key is hot.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                context, bytes_, three, two = batch.slice(at, 1024).columns
                context = context.to_numpy()
                chance = _filled([_rows_of_counts(three), _rows_of_counts(two), *_below(context, last)])
                place = np.repeat(np.arange(len(context)), np.diff(bytes_.offsets.to_numpy()))
                after = bytes_.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[place] << 8 | after), pa.array(chance[place, after])], ["key", "chance"])

    wanted = keys.select("key").distinct().groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.collect_list(F.col("key").bitwiseAND(F.lit(255))).alias("bytes"))
    whole = wanted.join(others, "context").withColumn("ending", F.col("context").bitwiseAND(F.lit(65535)))
    return whole.join(endings, "ending").select("context", "bytes", "three", "two").mapInArrow(
        frugal(work), "key long, chance double")


# ------------------------------------------------------------------- score


class _Vocabulary(dict):
    """Numbers of words: of a frequent word its place, of another -1 less its place among the rare ones."""

    def __init__(self, keys: np.ndarray) -> None:
        super().__init__()
        self.keys, self.rare = keys, []

    def __missing__(self, word: bytes) -> int:
        key = np.uint64(xxhash.xxh64_intdigest(word)).astype(np.int64)
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            self.rare.append(int(key))
            at = -len(self.rare)
        self[word] = at
        return at

    def trim(self) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
            self.rare.clear()


def frequent_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words, at most ``FREQUENT`` of them.

    Words are taken by classes of like counts, so that a few hundred class sizes settle which.
    """
    kind = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for r in sorted(words.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r["kind"]):
        taken += r["count"]
        if taken > FREQUENT:
            break
        least = r["kind"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = words.where(kind >= least).select("key", "n").toArrow()
    keys, counts = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(keys)
    return keys[order], counts[order]


def scores(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each document."""
    spark = documents.sparkSession
    counts = corpus_counts(documents)
    words = counts.where(F.col("kind") == WORD_COUNT)
    totals = {r["kind"]: (r["n"], r["rows"]) for r in counts.groupBy("kind").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    texts = totals.get(TEXT_COUNT, (0, 0))[0]
    tokens = totals.get(WORD_COUNT, (0, 0))[0] + texts
    kinds = totals.get(WORD_COUNT, (0, 0))[1] + (texts > 0)
    three, two, others, endings = trie_counts(counts.where(F.col("kind") == GRAM_COUNT).select("key", "n"))
    known3, known2, table = trie_table(three, two)
    keys, often = frequent_words(words)
    shared = spark.sparkContext.broadcast((known3, known2, _bitmap(others), table, keys, np.log10(often + ADDED)))
    end = math.log10(texts + ADDED)
    below = math.log10(tokens + ADDED * (kinds + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known3, known2, joined, logs, keys, log_counts = shared.value
        rows, logs, zeros = row_numbers(known3, known2, joined), logs.ravel(), joined_row(known3, known2)
        vocabulary = _Vocabulary(keys)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(2).to_pylist():
                text = text.lower()
                own = text.split()
                ids = np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own))
                often = ids[ids >= 0]
                rare, times = np.unique(-1 - ids[ids < 0], return_counts=True)
                names = [vocabulary.rare[i] for i in rare.tolist()]
                score, grams = 0.0, []
                for context, after in _slices(text):
                    own_row = rows[context]
                    score += float(logs[own_row.astype(np.int64) << 8 | after].sum(dtype=np.float64))
                    at = np.flatnonzero(own_row == zeros)
                    if len(at):
                        grams.append(context[at].astype(np.int64) << 8 | after[at])
                grams, gram_times = np.unique(np.concatenate(grams), return_counts=True) if grams else ((), ())
                base = float(log_counts[often].sum()) + end
                out.append((row, len(own) + 1, len(often) + (texts > 0), base, score, names, times.tolist(), grams, gram_times))
                row += 1
                vocabulary.trim()
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rare", "times", "grams", "gram_times"],
            )

    scored = store(_rows(documents).mapInArrow(
        frugal(work), "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, "
        "rare array<long>, times array<long>, grams array<long>, gram_times array<long>",
    ))
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times")).alias("key", "times"))
    grams = scored.select("row", F.inline(F.arrays_zip("grams", "gram_times")).alias("key", "times"))
    n = F.coalesce("n", F.lit(0))
    by_word = rare.join(words.select("key", "n"), "key", "left").select(
        "row", (F.col("times") * F.log10(n + ADDED)).alias("more"), F.when(n > 0, F.col("times")).otherwise(0).alias("more_known"),
        F.lit(0.0).alias("more_score"),
    )
    by_gram = grams.join(joined_chances(grams, others, endings, last_counts(two)), "key").select(
        "row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), (F.col("times") * F.col("chance")).alias("more_score"),
    )
    found = by_word.unionByName(by_gram).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_known", "more_score")])
    whole = scored.drop("rare", "times", "grams", "gram_times").join(found, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
