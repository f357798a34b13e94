"""Sketches, buckets and components of near-duplicates by MinHash."""

import collections
import random

import numpy as np
import pytest

from linkgauge.llm import common, minhash
from linkgauge.llm.components import components

from . import brute
from .tables import sentence


def similar_classes(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id, kept)] from all pairs."""
    sets = []
    for _, t in rows:
        own = brute.words(brute.lowered(t))
        sets.append(set(zip(own, own[1:])) if len(own) > 1 else {tuple(own)} - {()})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)] += [] if d is None else [d]
    ids = [min(least[top(i)], default=None) for i in range(len(rows))]
    return [(d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, ids)]


def families(seed):
    """Texts whose versions drift apart, so that components are chains, besides many exact copies."""
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        own = sentence(rng, 120, 5000).split()
        for _ in range(25):
            own = list(own)
            for _ in range(rng.choice((2, 5, 9, 14))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += [rows[0]] * 30 + ["a b c"] * 3 + ["a b c d", "a b c d e", "a b c d e f", "A b C d E f g", "b c d e f g"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limit,few", [(1000, 20), (5, 1)])
def test_components_against_all_pairs(spark, monkeypatch, limit, few):
    monkeypatch.setattr(minhash, "LIMIT", limit)
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(common, "HOT", limit)
    rows = families(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(frame).collect()))
    assert got == sorted(similar_classes(rows))
    assert 6 < len({r[2] for r in got}) < 120


def test_links_are_found_when_nothing_else_is(spark):
    """Pairs exactly at the limit: 80 of 100 shingles."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 200, 2):
        own = [f"{i}w{k}" for k in range(91)]
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:81] + [f"{i}v{k}" for k in range(10)]))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] % 2 for r in minhash.near_duplicates(frame).collect()} == {0}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 199, 5000):
        elements = rng.integers(1, 2**62, size).astype(np.uint64)
        found = minhash.sketch(np.unique(elements))
        assert (found != minhash.EMPTY).all()
    for similarity in (0.2, 0.5, 0.8):
        shared = []
        for _ in range(60):
            x = rng.integers(1, 2**62, 1000).astype(np.uint64)
            both = int(1000 * 2 * similarity / (1 + similarity))
            y = np.concatenate((x[:both], rng.integers(1, 2**62, 1000 - both).astype(np.uint64)))
            shared.append((minhash.sketch(x) == minhash.sketch(y)).mean())
        assert np.mean(shared) == pytest.approx(similarity, abs=0.02)
        assert np.std(shared) < 1.5 * (similarity * (1 - similarity) / minhash.SIZE) ** 0.5


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for size in (3, 100, 3000):
        x = np.unique(rng.integers(1, 2**62, size).astype(np.uint64))
        y = np.unique(np.concatenate((x[size // 4 :], rng.integers(1, 2**62, size // 5).astype(np.uint64))))
        bits = int(np.bitwise_count(minhash.parities(x) ^ minhash.parities(y)).sum())
        assert bits <= len(np.setxor1d(x, y))
        assert size != 100 or bits > 0.9 * len(np.setxor1d(x, y))


def test_sketch_is_the_same_whatever_is_thrown_at_once(monkeypatch):
    elements = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at_once = minhash.sketch(elements)
    monkeypatch.setattr(minhash, "THROWN", 1)
    assert (minhash.sketch(elements) == at_once).all()


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    links = [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (240, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(101, 160)} | {(i, 3) for i in range(200, 241)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_rounds_take_few_tasks(spark):
    wanted = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1000) for i in range(300)], "a long, b long"))
        assert sorted(found.collect()) == [(i + 1000, i) for i in range(300)]
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
