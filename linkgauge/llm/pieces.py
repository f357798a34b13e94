"""SentencePiece encoding by sampling, and lossless decoding.

A text's segmentation is drawn from the lattice of all its segmentations into pieces: probabilities are filtered forward
and pieces sampled backward, with random numbers that are hashes of the row key, the place in the text and
the step. So a row's pieces are the same in every run, whatever task or batch it is in.

A segmentation is as probable as the product of its pieces' weights. The weights of a unigram model are its scores; a BPE
model has ranks instead, and a piece of rank r weighs 1 / (r + 1), Zipf's law. ``SHARPNESS`` is an exponent: 0 makes all segmentations
alike, a great one takes the best.

No piece goes on over the beginning of a blank, so a text falls into parts whose lattices are independent. Parts repeat, so the lattice of each is
built once per task, for thousands of parts at a time, and then all occurrences are sampled at once.

Decoding is lossless for every text: the blank in front that the model adds is taken away again, characters without
a piece are spelled in bytes, and so is the character that stands for blanks inside the model's pieces.

Scale: one pass over the texts where they lie, no shuffle. The trie of the pieces is broadcast, as long as the vocabulary. A task remembers a bounded number of parts and takes a bounded number of
occurrences at a time, beyond one whole text.

Defined cases: a null text has null pieces, an empty one has none. Rows with equal keys and texts get equal pieces. A null
key is a key like others. An empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: The vocabulary file; the driver reads it, and ``decoded`` in every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 42
BLANK_SIGN = "\N{LOWER ONE EIGHTH BLOCK}"
#: Log weight of a character spelled in bytes, below that of the least piece.
SPELLED = -10.0
#: Lattice edges that a task remembers, and occurrences of parts that it samples at a time.
REMEMBERED, AT_ONCE = 2_000_000, 60_000
#: Edges that a byte of new parts is reckoned to take.
EDGES_PER_BYTE = 4
#: New parts whose lattices are built at a time, in bytes.
BUILT = 1 << 15
#: Texts that are Python's own strings of bytes at a time.
TAKEN = 256

Sampled = tuple[np.ndarray, np.ndarray]


class Model:
    """The pieces of a vocabulary as a byte trie, with their weights."""

    def __init__(self, path: str = MODEL) -> None:
        file = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(file.vocab_size())
        plain = [
            i for i in numbers if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i))
        ]
        self.bytes = [b""] * len(numbers)
        self.spelling = np.full(256, -1, np.int32)
        for i in numbers:
            if file.is_byte(i):
                value = int(file.id_to_piece(i)[1:-1], 16)
                self.spelling[value], self.bytes[i] = i, bytes([value])
        if (self.spelling < 0).any():
            raise ValueError("the vocabulary has no pieces for single bytes")
        for i in plain:
            self.bytes[i] = file.id_to_piece(i).replace(BLANK_SIGN, " ").encode()
        if any(b" " in self.bytes[i].lstrip(b" ") for i in plain):
            raise ValueError("the vocabulary has pieces that go on over a blank")
        ranks = all(file.get_score(i) <= 0 and file.get_score(i) == int(file.get_score(i)) for i in plain)
        scores = np.array([file.get_score(i) for i in numbers])
        self.weights = -np.log1p(np.maximum(-scores, 0)) if ranks else scores
        self.least = min(self.weights[i] for i in plain)
        newline = not any(b"\n" in self.bytes[i] for i in plain)
        #: Parts that no piece crosses the borders of.
        self.parts = re.compile(rb" *[^ \n]+| +|\n" if newline else rb" *[^ ]+| +")
        self._trie([(self.bytes[i], i) for i in plain])

    def _trie(self, pieces: list[tuple[bytes, int]]) -> None:
        """The trie as sorted edges, node << 8 | byte, with the node each leads to: a few hundred kilobytes."""
        edges: dict[int, int] = {}
        ends = [-1]
        for piece, number in pieces:
            node = 0
            for byte in piece:
                after = edges.get(node << 8 | byte)
                if after is None:
                    after = edges[node << 8 | byte] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = number
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges = keys[order]
        self.children = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.ends = np.array(ends, np.int32)
        self.first = self.after(np.zeros(256, np.int64), np.arange(256))

    def after(self, nodes: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, 0 where there are none."""
        wanted = nodes << 8 | following
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.children[at], 0)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


class Lattices:
    """Lattices of parts of texts, and samples from them.

    All lattices share one numbering of nodes. Edges are sorted by the node they end at; ``keys`` has,
    above the node, the running probability of its edges in 2**32nds, so that one sorted search draws an edge.
    """

    def __init__(self, model: Model, sharpness: float = SHARPNESS) -> None:
        self.model, self.sharpness = model, sharpness
        self.clear()

    def clear(self) -> None:
        self.ends: dict[bytes, int] = {}
        self.nodes = 0
        self.keys, self.starts, self.pieces, self.first = array("Q"), array("i"), array("i"), array("b")
        self.text = bytearray()

    def add(self, parts: set[bytes]) -> None:
        """Build the lattices of new parts."""
        group, size = [], 0
        for part in parts:
            group.append(part)
            size += len(part)
            if size >= BUILT:
                self._build(group)
                group, size = [], 0
        if group:
            self._build(group)

    def _edges(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte the edge starts at, its length, its piece or -1 for a character spelled in bytes)."""
        model = self.model
        begins = np.flatnonzero((text & 0xC0) != 0x80)
        size = np.ones(len(text), np.int64)
        for lead, length in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            size[text >= lead] = length
        out, at, state, length = [], begins, None, 0
        single = np.zeros(len(text), bool)
        while len(at):
            state = model.after(state, text[at + length]) if length else model.first[text[at]]
            length += 1
            at, state = at[state > 0], state[state > 0]
            found = model.ends[state]
            hit = found >= 0
            out.append((at[hit], np.full(int(hit.sum()), length, np.int64), found[hit]))
            single[at[hit & (size[at] == length)]] = True
            more = at + length < stop[at]
            at, state = at[more], state[more]
        spelled = begins[~single[begins]]
        out.append((spelled, size[spelled], np.full(len(spelled), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _build(self, parts: list[bytes]) -> None:
        lengths = np.array([len(p) for p in parts])
        text = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum(lengths) - lengths
        stop = np.repeat(begin + lengths, lengths)
        # a part of n bytes has n + 1 nodes
        of_part = np.repeat(np.arange(len(parts)), lengths)
        start, length, piece = self._edges(text, stop)
        weight = np.where(piece >= 0, self.model.weights[np.maximum(piece, 0)], self.model.least + SPELLED) * self.sharpness
        depth = start - begin[of_part[start]] + length  # of the node where the edge ends
        source = start + of_part[start]
        target = source + length
        # by target, then source: no two edges have both, and no target is before a source
        order = np.argsort(target * (int(length.max()) + 1) - length)
        source, target, depth, weight, piece, start = (x[order] for x in (source, target, depth, weight, piece, start))
        by_depth = np.argsort(depth.astype(np.uint16) if lengths.max() < 1 << 16 else depth, kind="stable")
        depth, to_all, value_all = depth[by_depth], target[by_depth], weight[by_depth]
        from_all = source[by_depth]
        forward = np.full(len(text) + len(parts), -np.inf)
        forward[begin + np.arange(len(parts))] = 0.0
        shares = np.empty(len(source), np.int64)
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)]):
            value = forward[from_all[a:b]] + value_all[a:b]
            to = to_all[a:b]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            sizes = np.diff(np.concatenate((heads, [b - a])))
            top = np.maximum.reduceat(value, heads)
            total = np.add.reduceat(np.exp(value - np.repeat(top, sizes)), heads)
            log = top + np.log(total)
            forward[to[heads]] = log
            shares[by_depth[a:b]] = np.rint(np.exp(value - np.repeat(log, sizes)) * 2.0**32)
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(target)])))
        running = np.cumsum(shares)
        running -= np.repeat(running[heads] - shares[heads], sizes)
        running = np.minimum(running, 1 << 32)
        running[heads + sizes - 1] = 1 << 32
        nodes = target.astype(np.uint64) + np.uint64(self.nodes)
        self.keys.frombytes(((nodes << np.uint64(32)) + running.astype(np.uint64)).tobytes())
        self.starts.frombytes((source + self.nodes).astype(np.int32).tobytes())
        # of a spelled character the place of its bytes, below 0
        self.pieces.frombytes(np.where(piece >= 0, piece, -1 - (start + len(self.text))).astype(np.int32).tobytes())
        self.first.frombytes((source == (begin + np.arange(len(parts)))[of_part[start]]).astype(np.int8).tobytes())
        ends = (begin + lengths + np.arange(len(parts)) + self.nodes).tolist()
        self.ends.update(zip(parts, ends))
        self.nodes += len(text) + len(parts)
        self.text += text.tobytes()

    def sample(self, nodes: np.ndarray, seeds: np.ndarray) -> Sampled:
        """(pieces of all occurrences in order, number of pieces of each). An occurrence is the last node of its
        part and a seed."""
        keys, starts = np.frombuffer(self.keys, np.uint64), np.frombuffer(self.starts, np.int32)
        pieces, first = np.frombuffer(self.pieces, np.int32), np.frombuffer(self.first, np.int8)
        text = np.frombuffer(bytes(self.text), np.uint8)
        counts = np.zeros(len(nodes), np.int64)
        live, steps = np.argsort(nodes), []  # neighbours search in the same place
        node = nodes[live]
        while len(live):
            draw = _hashed(seeds[live], len(steps)) >> np.uint64(32)
            edge = np.searchsorted(keys, (node.astype(np.uint64) << np.uint64(32)) + draw, side="right")
            found = pieces[edge]
            size = np.ones(len(live), np.int64)
            spelled = np.flatnonzero(found < 0)
            if len(spelled):
                lead = text[-1 - found[spelled]]
                size[spelled] = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
            counts[live] += size
            steps.append((live, found, size))
            more = first[edge] == 0
            live, node = live[more], starts[edge[more]]
        place = np.cumsum(counts)
        out = np.empty(place[-1] if len(place) else 0, np.int32)
        for live, found, size in steps:
            place[live] -= size
            plain = found >= 0
            out[place[live[plain]]] = found[plain]
            spelled = np.flatnonzero(~plain)
            for j in range(4 if len(spelled) else 0):
                own = spelled[size[spelled] > j]
                out[place[live[own]] + j] = self.model.spelling[text[-1 - found[own] + j]]
        return out, counts


def _hashed(seeds: np.ndarray, step: int) -> np.ndarray:
    x = seeds + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(lattices: Lattices, keys: list, texts: list[bytes], seed: int = SEED) -> Iterator[Sampled]:
    """(pieces of some whole texts, number of pieces of each of them), over all texts in order."""
    some, total = [], 0
    for key, text in zip(keys, texts):
        own = lattices.model.parts.findall(b" " + text) if text else []
        some.append((key, own))
        total += len(own)
        if total >= AT_ONCE:
            yield _drawn(lattices, some, seed)
            some, total = [], 0
    if some:
        yield _drawn(lattices, some, seed)


def _drawn(lattices: Lattices, some: list[tuple], seed: int) -> Sampled:
    every = set().union(*(own for _, own in some))
    new = every - lattices.ends.keys()
    if len(lattices.keys) + EDGES_PER_BYTE * sum(map(len, new)) > REMEMBERED:
        lattices.clear()
        new = every
    lattices.add(new)
    sizes = np.array([len(own) for _, own in some])
    every_part = chain.from_iterable(own for _, own in some)
    nodes = np.fromiter(map(lattices.ends.__getitem__, every_part), np.int64, int(sizes.sum()))
    bases = np.array([xxhash.xxh64_intdigest(repr(key).encode(), seed) for key, _ in some], np.uint64)
    place = np.arange(len(nodes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = _hashed(place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.repeat(bases, sizes), 1 << 20)
    found, counts = lattices.sample(nodes, seeds)
    return found, np.bincount(np.repeat(np.arange(len(some)), sizes), counts, len(some)).astype(np.int64)


def encoded(
    documents: DataFrame, key: str = "doc_id", path: str = MODEL, sharpness: float = SHARPNESS, seed: int = SEED
) -> DataFrame:
    """Rows (key, n_tokens, token_ids, round_trip), one for each document.

    round_trip: whether the pieces, decoded, are the text; null for a null text.
    """

    shared = documents.sparkSession.sparkContext.broadcast(Model(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lattices = Lattices(model, sharpness)
        for batch in batches:
            for start in range(0, batch.num_rows, TAKEN):
                given = batch.column(0).slice(start, TAKEN)
                keys, texts = given.to_pylist(), batch.column(1).slice(start, TAKEN).to_pylist()
                at = 0
                for ids, counts in encode(lattices, keys, texts, seed):
                    own = texts[at : at + len(counts)]
                    ends = np.cumsum(counts)
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    null = np.array([t is None for t in own], bool)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null))
                    every = ids.tolist()
                    same = [
                        None if t is None else model.decode(every[a:b]).encode() == t
                        for t, a, b in zip(own, offsets.tolist(), ends.tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [given.slice(at, len(own)), pa.array(counts), lists, pa.array(same, pa.bool_())],
                        [key, "n_tokens", "token_ids", "round_trip"],
                    )
                    at += len(own)

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(work), f"`{key}` {kind}, n_tokens long, token_ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """Rows with a column ``text``, decoded from ``token_ids``."""

    def work(batches: Iterator) -> Iterator:
        model = Model(path)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else model.decode(x.tolist()))

    from pandas import Series

    work.__annotations__ = {"batches": Iterator[Series], "return": Iterator[Series]}
    return rows.withColumn("text", F.pandas_udf(work, "string")(F.col("token_ids")))
