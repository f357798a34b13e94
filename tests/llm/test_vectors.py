"""Centroid search, exact polynomials and components on matrices that are known."""

import random

import numpy as np
import pytest

from linkgauge.llm import clusters, whitening
from linkgauge.llm.whitening import FRACTION


@pytest.mark.parametrize("leaf", [1, 3, 50])
def test_tree_finds_nearest_with_ties(leaf):
    rng = np.random.default_rng(1)
    points = rng.integers(-3, 4, (40, 3))
    points[7] = points[20]
    vectors = rng.integers(-4, 5, (500, 3))
    which, square, _ = clusters.VantageTree(points, leaf).nearest(vectors)
    every = ((vectors[:, None] - points) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_tree_opens_few_subtrees_of_clustered_points():
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, (20, 64))
    points = np.concatenate([c + rng.integers(-500, 500, (30, 64)) for c in centres])
    vectors = points + rng.integers(-50, 50, points.shape)
    which, _, taken = clusters.VantageTree(points).nearest(vectors)
    assert (which == np.arange(len(points))).all()
    assert taken < len(points) ** 2 / 5


def test_tree_of_far_apart_numbers_and_one_point():
    points = np.array([[1 << 27, -(1 << 27)], [1 << 27, (1 << 27) - 1]])
    vectors = np.array([[-(1 << 27), 0], [0, 0]])
    which, square, _ = clusters.VantageTree(points, 1).nearest(vectors)
    assert which.tolist() == [1, 1] and square.tolist()[1] == (1 << 54) + ((1 << 27) - 1) ** 2
    assert clusters.VantageTree(points[:1]).nearest(vectors)[0].tolist() == [0, 0]


def test_fewer_vectors_than_clusters_and_large_components(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    rows, centroids = clusters.clustered(few, dimension=2)
    assert sorted(map(tuple, rows.collect())) == [(i, c, 0) for (i, c) in sorted((r["vec_id"], r["cluster"]) for r in rows.collect())]
    assert len(centroids) == 2
    huge = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters.clustered(huge, dimension=2)


def polynomial(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_polynomial_of_random_matrices(spark, size):
    rng = random.Random(size)
    half = np.array([[rng.randrange(-10**6, 10**6) for _ in range(size)] for _ in range(size)], object)
    half[:, 0] = 0  # a zero eigenvalue, and columns without a pivot
    whole = half @ half.T
    got = whitening.characteristic_polynomial(spark, whole)
    # Newton's identities on exact traces of powers
    power, traces = whole, []
    for _ in range(size):
        traces.append(int(sum(power.diagonal())))
        power = power @ whole
    expected = [1]
    for k in range(1, size + 1):
        expected.append(-sum(expected[k - i] * traces[i - 1] for i in range(1, k + 1)) // k)
    assert got == expected[::-1]


def test_roots_are_counted_and_refined():
    p = polynomial([0, 0, 1, 2, 2, 2, 10**20, 10**20 + 1])
    assert [whitening.roots_above(p, 2 * k, 1) for k in (0, 1, 2, 10**20)] == [6, 5, 2, 1]
    found = whitening.greatest_roots(p, 6)
    assert [(r.value + (1 << FRACTION - 1) >> FRACTION, r.times) for r in found] == [(10**20 + 1, 1), (10**20, 1), (2, 3), (1, 1)]
    assert whitening.greatest_roots(p, 2)[1].value == 10**20 << FRACTION
    assert whitening.greatest_roots([0, 0, 1], 3) == []
    golden = whitening.greatest_roots([1, -3, 1], 2)  # (3 + sqrt 5) / 2 and its inverse
    assert abs(golden[0].value * golden[1].value - (1 << 2 * FRACTION)) < 1 << FRACTION + 2


def test_multiple_roots_have_orthogonal_vectors(spark):
    whole = np.array([[5, 1, 1, 0], [1, 5, 1, 0], [1, 1, 5, 0], [0, 0, 0, 4]], object)
    values, vectors = whitening.components_of(spark, whole, 4)
    assert np.array(values, float) / 2.0**FRACTION == pytest.approx([7, 4, 4, 4])
    assert vectors.T @ vectors == pytest.approx(np.eye(4), abs=1e-12)
    assert whole.astype(float) @ vectors == pytest.approx(vectors * [7, 4, 4, 4], abs=1e-12)


def test_whitening_beyond_the_rank(spark):
    rows = [(1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 4.0]), (3, [4.0, 0.0, 8.0]), (3, [4.0, 0.0, 8.0]), (4, [1.0]), (5, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whitened(frame).orderBy("vec_id", "component").collect()
    assert len(out) == 12 and {r["identity_error"] < 1e-12 for r in out} == {True}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out)
    assert [round(r["explained"], 9) for r in out[:3]] == [1, 0, 0]
    one = whitening.whitened(frame.where("vec_id = 2")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0)] * 3


def test_sums_of_large_entries_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-(2**29), 2**29) for _ in range(3)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(np.floor(1024 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    expected = {i: sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    out = whitening.whitened(frame).collect()
    assert {r["vec_id"]: int(r["deviation_digits"]) for r in out} == expected
    assert all(r["deviation"] == (expected[r["vec_id"]] if expected[r["vec_id"]] < 2**63 else None) for r in out)
    assert max(r["identity_error"] for r in out) < 1e-9
