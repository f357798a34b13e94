"""Substring dedup by seeds that are extended to repeats.

Every text is winnowed: of each ``WINDOW`` consecutive words the least hash of ``GRAM`` words is an anchor, so
equal windows have the same anchor at the same place. The windows of one anchor lie side by side; the words they cover
are the anchor's stretch, the seed extended to both sides as far as windows take part in it.

Documents are joined on their anchors. Where all documents with an anchor have the same stretch, all but the smallest id lose its
windows. Where stretches differ, which is at the ends of repeats, the smallest id of each stretch has its windows compared
one by one by a digest of 126 bits. Windows that overlap or touch make one maximal repeat.

Scale: anchors are two ninths of the words, 24 bytes each, and are shuffled once. An anchor's documents are never
gathered: rows come sorted and are passed on in a stream that remembers one row. What repeats within one batch of
documents is settled there, so a stretch or a window that a third of all documents share sends one row of each
batch to its task, and the rest are dealt out evenly. Texts are shuffled twice, compressed: to compare windows, and to be cut.

Defined cases: a null text has no words. A text shorter than a window keeps all its words. A null id is neither smaller nor
greater than another, so such rows lose nothing and take nothing. Rows with the same id don't remove from one another. An
empty table gives an empty result. ``deduplicated`` carries all other columns along.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, store

WINDOW = 13
GRAM = 6
#: Words whose hashes a task remembers at most.
REMEMBERED = 500_000
#: Texts that are cut at a time.
TAKEN = 256
WORDS = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
#: Odd numbers that weigh the words of a gram or window; a fixed series.
FACTORS = (np.random.Generator(np.random.Philox(13)).integers(0, 2**63, (3, 256), np.uint64) << np.uint64(1)) + np.uint64(1)


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(ids: np.ndarray, length: int, series: int) -> np.ndarray:
    """A hash of each run of so many words, with its last bit clear."""
    n = len(ids) - length + 1
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += ids[j : j + n] * FACTORS[series, j]
    return _mixed(total) & ~np.uint64(1)


def anchors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its anchor: the first of its least grams."""
    grams = _runs(ids, GRAM, 0)
    wide = WINDOW - GRAM + 1
    seen = np.lib.stride_tricks.sliding_window_view(grams, wide)
    return grams, seen.argmin(axis=1) + np.arange(len(seen))


def _ends(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted columns, where runs of equal rows start, and where they end."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([True], change)), np.concatenate((change, [True]))


def stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of its stretch, its first window, the window behind its last) for each anchor of a text.

    The hash covers the stretch's windows and their places around the anchor; its last bit is clear, like an anchor's.
    """
    grams, at = anchors(ids)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    place = (np.arange(len(at)) - at).astype(np.uint64)
    whole = np.add.reduceat(_mixed(_runs(ids, WINDOW, 1) + place * FACTORS[0, -1]), first)
    return grams[at[first]], whole, first, np.concatenate((first[1:], [len(at)]))


def _packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else zlib.compress(t, 1))


def packed(text: Column) -> Column:
    """A text for a shuffle; half of what the shuffle's own compression leaves."""
    return F.pandas_udf(frugal(_packed), "binary")(text.cast("binary"))


# ------------------------------------------------------------------- seeds


def _batch_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of keys and a document, sorted. The last bit of the first key marks rows whose keys a smaller
    document of the batch has."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    one = _ends(*columns)[0]
    columns = [c[one] for c in columns]
    marked = ~_ends(*columns[:-1])[0]
    return columns[0] | marked.astype(np.uint64), *columns[1:]


def _dealt(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Rows by their first keys, marked ones anywhere, sorted by all keys and document."""
    marked = F.col(by[0]).bitwiseAND(F.lit(1)) == 1
    where = F.when(marked, F.xxhash64(*keys, "doc")).otherwise(F.xxhash64(*by))
    return rows.repartition(where).sortWithinPartitions(*keys, "doc")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (anchor, stretch, doc): those with a smaller document beside the same stretch, which are lost, and the first
    document of each of an anchor's several stretches, which are open."""
    held = None  # anchor, stretch, its first document, whether that waits, whether the anchor has several stretches
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, stretch, docs = (batch.column(i).to_numpy() for i in range(3))
        waits, several = np.ones(len(docs), bool), False
        ghost = bool(held and held[0] == anchor[0])
        if ghost:
            anchor, stretch, docs = (np.concatenate(([x], y)) for x, y in zip(held, (anchor, stretch, docs)))
            waits, several = np.concatenate(([held[3]], waits)), held[4]
        of_anchor, of_stretch = _ends(anchor)[0], _ends(anchor, stretch)[0]
        run = np.cumsum(of_anchor) - 1
        many = np.bincount(run, of_stretch) > 1
        many[0] |= several
        at = np.flatnonzero(of_stretch)
        first = docs[at][np.cumsum(of_stretch) - 1]
        marked = (anchor & 1) == 1
        lost = marked | (docs > first)
        opened = of_stretch & many[run] & waits & ~marked
        held = (anchor[-1], stretch[-1], first[-1], not many[-1], bool(many[-1]))
        out = lost | opened
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[out]), pa.array(stretch[out]), pa.array(lost[out])], ["doc", "stretch", "lost"]
        )


def seeds(documents: DataFrame) -> DataFrame:
    """Stored rows (doc, lost, opened) of hashes of stretches: those to be removed, and those whose windows are open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Hashes()
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.of(text.split())
                if len(ids) >= WINDOW:
                    anchor, stretch, _, _ = stretches(ids)
                    parts.append((anchor, stretch.view(np.int64), np.full(len(anchor), doc, np.int64)))
            if parts:
                anchor, stretch, docs = _batch_rows(*(np.concatenate(p) for p in zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(stretch), pa.array(docs)], ["anchor", "stretch", "doc"]
                )

    rows = documents.mapInArrow(frugal(work), "anchor long, stretch long, doc long")
    found = _dealt(rows, ["anchor"], ["anchor", "stretch"]).mapInArrow(frugal(_shared), "doc long, stretch long, lost boolean")
    return store(found.groupBy("doc").agg(
        F.collect_set(F.when(F.col("lost"), F.col("stretch"))).alias("lost"),
        F.collect_set(F.when(~F.col("lost"), F.col("stretch"))).alias("opened"),
    ))


# ----------------------------------------------------------------- windows


def _inside(first: np.ndarray, after: np.ndarray, number: int) -> np.ndarray:
    """Which of so many windows lie in one of the stretches."""
    edge = np.zeros(number + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, after, -1)
    return np.cumsum(edge)[:-1] > 0


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, doc): the windows that a smaller document has too."""
    held = None  # the key of the last run and its smallest document
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, docs = (batch.column(i).to_numpy() for i in range(3))
        if held and held[:2] == (a[0], b[0]):
            a, b, docs = (np.concatenate(([x], y)) for x, y in zip(held, (a, b, docs)))
        start = _ends(a, b)[0]
        least = docs[np.flatnonzero(start)][np.cumsum(start) - 1]
        held = (a[-1], b[-1], least[-1])
        keep = (docs > least) | ((a & 1) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep] & ~1), pa.array(docs[keep])], ["a", "doc"])


def removed_windows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc, windows): of the open stretches the windows that a smaller id has too."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Hashes()
        for batch in batches:
            parts = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = words.of(zlib.decompress(text).split())
                if len(ids) < WINDOW:
                    continue
                _, stretch, first, after = stretches(ids)
                hit = np.isin(stretch.view(np.int64), own.values.to_numpy())
                at = np.flatnonzero(_inside(first[hit], after[hit], len(ids) - WINDOW + 1))
                a, b = _runs(ids, WINDOW, 1)[at], _runs(ids, WINDOW, 2)[at]
                parts.append((a, b, np.full(len(at), doc, np.int64)))
            rows = [np.concatenate(p) for p in zip(*parts)]
            if rows and len(rows[0]):
                a, b, docs = _batch_rows(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(docs)], ["a", "b", "doc"]
                )

    opened = found.where(F.size("opened") > 0).select("doc", "opened")
    rows = documents.select("doc", packed(F.col("text")).alias("text")).join(opened, "doc")
    rows = rows.select("doc", "text", "opened").mapInArrow(frugal(extended), "a long, b long, doc long")
    later = _dealt(rows, ["a", "b"], ["a", "b"]).mapInArrow(frugal(_later), "a long, doc long")
    return later.groupBy("doc").agg(F.collect_set("a").alias("windows"))


# ------------------------------------------------------------------- texts


def _covered(words: list[bytes], lost: np.ndarray, windows: np.ndarray, hashes: _Hashes) -> np.ndarray:
    """Which words lie in one of the windows, or in a window of the stretches."""
    ids = hashes.of(words)
    if len(ids) < WINDOW:
        return np.zeros(len(ids), bool)
    _, stretch, first, after = stretches(ids)
    hit = np.isin(stretch.view(np.int64), lost)
    removed = _inside(first[hit], after[hit], len(ids) - WINDOW + 1)
    removed |= np.isin(_runs(ids, WINDOW, 1).view(np.int64), windows)
    at = np.flatnonzero(removed)
    return _inside(at, at + WINDOW, len(ids))


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of each run."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words and the blanks behind them."""
    starts = [m.start() for m in WORDS.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : starts[a]])
        done = starts[b]
    return b"".join(out) + text[done:]


FOUND = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, after: long>>, kept_text string"


def _kept(with_text: bool) -> Column:
    def some(hashes: _Hashes, *columns: pd.Series) -> pd.DataFrame:
        rows = []
        for text, *own in zip(*columns):
            given = b"" if text is None else zlib.decompress(text)
            words = given.split()
            own = [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in own]
            spans, kept = [], words
            if len(own[0]) or len(own[1]):
                covered = _covered(words, *own, hashes)
                spans = _spans(covered)
                kept = [w for w, c in zip(words, covered.tolist()) if not c]
            shown = _cut(given, spans).decode() if with_text and text is not None else None
            rows.append((
                len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(),
                [{"first": a, "after": b} for a, b in spans], shown,
            ))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            for start in range(0, len(batch[0]), TAKEN):
                yield some(hashes, *(column[start : start + TAKEN] for column in batch))

    return F.pandas_udf(frugal(work), FOUND)("packed_text", "lost", "windows")


def _with_found(documents: DataFrame, columns: list[Column], with_text: bool) -> DataFrame:
    """The given columns and ``found`` of every document."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text")
    ).where("doc IS NOT NULL AND text IS NOT NULL")
    seeded = seeds(rows)
    windows = removed_windows(rows, seeded)
    lost = seeded.where(F.size("lost") > 0).select("doc", "lost")
    found = store(lost.join(windows, "doc", "full")).withColumnRenamed("doc", "of")
    own = documents.select(
        *columns, F.col("doc_id").cast("long").alias("doc"), packed(F.col("text")).alias("packed_text")
    )
    return own.join(found, F.col("doc") == F.col("of"), "left").withColumn("found", _kept(with_text))


def repeats(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, spans), one for each document.

    spans are the maximal repeats: number of the first word, and of the first one behind.
    """
    rows = _with_found(documents, [F.col("doc_id")], False)
    return rows.select("doc_id", *[f"found.{c}" for c in ("n_words", "n_removed", "kept_sha256", "spans")])


def deduplicated(documents: DataFrame) -> DataFrame:
    """All documents with their own columns, without the repeated words in their texts.

    A text of which nothing is removed stays as it is; ``n_chars``, where there is one, follows the text.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row")
    rows = _with_found(documents, [others], True)
    own = {c: F.col("row").getField(c) for c in documents.columns if c != "text"}
    own["text"] = F.col("found.kept_text")
    if "n_chars" in own:
        length = F.when(F.col("found.n_removed") > 0, F.length(own["text"])).otherwise(own["n_chars"])
        own["n_chars"] = length.cast(documents.schema["n_chars"].dataType)
    return rows.select(*[own[c].alias(c) for c in documents.columns])
