"""Embedding whitening by the exact characteristic polynomial of the scatter matrix.

Vectors become whole numbers x, so the scatter matrix M = n * sum(x x') - S S' is exact, and the covariance is M / n**2. The polynomial
of M is worked out modulo many primes, by reduction to Hessenberg form, and put together by Chinese remainders. All its roots are real, so
Descartes' rule counts them exactly: the roots above a number are the sign changes of the polynomial shifted there. Bisection isolates the
greatest ones, signs of the polynomial refine them to ``FRACTION`` binary digits behind the point. A
component is what inverse iteration in fixed-point numbers finds in the null space of M - root; roots that can't be told apart
are a multiple root, whose vectors are made orthogonal.

Scale: one pass sums products in tasks (in whole numbers, each task passes on dimension**2 sums), a second writes the whitened rows,
and an aggregate of these gives the error. Primes and roots are dealt out to tasks. What the driver holds depends on the dimension, and
by the logarithm on the number of vectors.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are vectors of another dimension than most (of two
as frequent: than the greater). Rows that repeat count each. A component beyond the rank of the data has variance 0: whitened is null, explained 0. There are
no more components than dimensions. ``deviation`` is null where it doesn't fit a long, which takes about a million vectors;
``deviation_digits`` has it as text. Entries beyond 2**30 raise. An empty table gives an empty result. Columns other than id and vector
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store
from .vectors import is_finite, matrix, whole_vectors

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
MOST = 1 << 40
#: Binary digits behind the point: of roots, and of the numbers of inverse iteration.
FRACTION, DIGITS = 128, 320
#: Roots closer than 2**-APART are one multiple root.
APART = 64
ITERATIONS = 3
#: Primes lie below this, so that products of two residues fit 64 bits.
BELOW = 1 << 31
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


# ----------------------------------------------------------------- scatter


def _products(own: np.ndarray, width: int) -> np.ndarray:
    """The sum of x x' over the rows, with x extended by a 1 at its end, as Python's whole numbers."""
    x = np.concatenate((own, np.ones((len(own), 1), np.int64)), axis=1)
    most = int(np.abs(x).max())
    if most * most * len(x) < EXACT:
        real = x.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    if len(x) > 1 and most * most < EXACT:
        half = len(x) // 2
        return _products(own[:half], width) + _products(own[half:], width)
    whole = x.astype(object)
    return whole.T @ whole


def dimension_of(vectors: DataFrame, column: str) -> int:
    """The most frequent number of entries of finite vectors, 0 without any."""
    sizes = vectors.where(is_finite(F.col(column))).groupBy(F.size(column).alias("size")).count()
    most = sizes.agg(F.max(F.struct("count", "size")).alias("most")).first()["most"]
    return most["size"] if most else 0


def moments(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums, and the sums of products of rows (vec_id, vector)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            if len(batch):
                total += _products(matrix(batch.column(0), width), width)
        upper = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in upper], pa.int32()), pa.array([j for _, j in upper], pa.int32()),
             pa.array([str(total[i, j]) for i, j in upper])], ["i", "j", "part"],
        )

    parts = rows.select("vector").mapInArrow(work, "i int, j int, part string")
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    full = np.zeros((width + 1, width + 1), object)
    for r in sums:
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = int(r["total"])
    return full[width, width], full[width, :width].tolist(), full[:width, :width]


# -------------------------------------------------------------- polynomial


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, with bases that decide up to 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: float) -> list[int]:
    """The greatest primes below ``BELOW`` whose product has at least so many bits."""
    found, have, n = [], 0.0, BELOW - 1
    while have < bits:
        if _is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return found


def polynomial_modulo(whole: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - whole) modulo a prime."""
    h = (whole % p).astype(np.int64)
    n = len(h)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + below[0]
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    # the polynomials of the leading blocks, one from all before it
    blocks = np.zeros((n + 1, n + 1), np.int64)
    blocks[0, 0] = 1
    for k in range(1, n + 1):
        own = np.zeros(n + 1, np.int64)
        own[1:] = blocks[k - 1, :-1]
        chain, weights = 1, np.empty(k, np.int64)
        for i in range(k - 1, -1, -1):
            weights[i] = h[i, k - 1] * chain % p
            chain = chain * int(h[i, i - 1]) % p
        blocks[k] = (own - (weights[:, None] * blocks[:k] % p).sum(axis=0)) % p
    return blocks[n]


def characteristic_polynomial(spark: SparkSession, whole: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(x - whole) for a whole matrix without negative eigenvalues.

    No coefficient exceeds the product of 1 + root, nor this the power of the mean of these factors.
    """
    width, trace = len(whole), int(sum(whole.diagonal()))
    chosen = primes(width * math.log2(1 + trace / width) + 64)
    entries = whole.tolist()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.array(entries, object)
        for batch in batches:
            found = [polynomial_modulo(own, int(p)).tolist() for p in batch["prime"]]
            yield pd.DataFrame({"prime": batch["prime"], "residues": found})

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in chosen], "prime long").repartition(tasks, "prime")
    rows = dealt.mapInPandas(work, "prime long, residues array<long>").collect()
    product = math.prod(chosen)
    parts = [(product // r["prime"]) * pow(product // r["prime"] % r["prime"], -1, r["prime"]) for r in rows]
    lifted = [sum(r["residues"][i] * part for r, part in zip(rows, parts)) % product for i in range(width + 1)]
    return [c - product if 2 * c > product else c for c in lifted]


# ------------------------------------------------------------------- roots


class Root(NamedTuple):
    """A root as a whole number of 2**-FRACTION, and how often it occurs."""

    value: int
    times: int


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """How many roots, all of them real, lie above at / 2**bits, multiple ones counted as often as they occur."""
    degree = len(polynomial) - 1
    shifted = [c << bits * (degree - i) for i, c in enumerate(polynomial)]
    for start in range(degree):
        for i in range(degree - 1, start - 1, -1):
            shifted[i] += at * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], at: int, bits: int) -> int:
    value, shift = 0, 0
    for c in reversed(polynomial):
        value = value * at + (c << shift)
        shift += bits
    return (value > 0) - (value < 0)


def greatest_roots(polynomial: list[int], want: int) -> list[Root]:
    """The greatest roots above 0, falling, until ``want`` of them (or a multiple one beyond) are found."""
    zeros = next(i for i, c in enumerate(polynomial) if c)
    positive = polynomial[zeros:]
    if len(positive) == 1:
        return []
    high = 1 << max(1, (-positive[-2]).bit_length())  # their sum
    found: list[Root] = []
    # intervals (low, high] in 2**-bits, with the numbers of roots above either end
    open_intervals = [(0, high, 0, len(positive) - 1, 0)]
    while open_intervals and sum(r.times for r in found) < want:
        low, high, bits, above_low, above_high = open_intervals.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:
            found.append(Root(_refined(positive, low, high, bits), 1))
        elif high - low == 1 and bits >= APART:
            found.append(Root((2 * low + 1) << (FRACTION - bits - 1), inside))
        else:
            if high - low == 1:
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            above = roots_above(positive, middle, bits)
            open_intervals += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return found


def _refined(polynomial: list[int], low: int, high: int, bits: int) -> int:
    """The only root in (low, high], to FRACTION bits."""
    end = _sign(polynomial, high, bits)
    while end:
        if high - low == 1:
            if bits == FRACTION:
                break
            low, high, bits = low << 1, high << 1, bits + 1
        middle = (low + high) // 2
        sign = _sign(polynomial, middle, bits)
        if sign == end:
            high = middle
        elif sign:
            low = middle
        else:
            high, end = middle, 0
    return high << (FRACTION - bits)


# -------------------------------------------------------------- components


def _factored(whole: np.ndarray, root: int) -> tuple[np.ndarray, list[int]]:
    """Triangular factors of whole - root with row exchanges, in fixed-point numbers of DIGITS bits."""
    a = whole << DIGITS
    width = len(a)
    for i in range(width):
        a[i, i] -= root << (DIGITS - FRACTION)
    order = list(range(width))
    for k in range(width):
        pivot = k + max(range(width - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < width:
            factors = (a[k + 1 :, k] << DIGITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :]) >> DIGITS
            a[k + 1 :, k] = factors
    return a, order


def _solved(a: np.ndarray, order: list[int], right: np.ndarray) -> np.ndarray:
    x = right[order]
    for i in range(1, len(x)):
        x[i] -= int(a[i, :i] @ x[:i]) >> DIGITS
    for i in range(len(x) - 1, -1, -1):
        x[i] = ((x[i] - (int(a[i, i + 1 :] @ x[i + 1 :]) >> DIGITS if i + 1 < len(x) else 0)) << DIGITS) // a[i, i]
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x << DIGITS) // math.isqrt(int(x @ x))


def null_vectors(whole: np.ndarray, root: Root) -> list[list[float]]:
    """Orthogonal unit vectors, one for each time the root occurs, by inverse iteration."""
    a, order = _factored(whole, root.value)
    width = len(whole)
    own = [
        _unit(np.array([
            int.from_bytes(hashlib.sha256(f"{n}:{i}".encode()).digest()[:16]) - (1 << 127) for i in range(width)
        ], object)) for n in range(root.times)
    ]
    for _ in range(ITERATIONS):
        for n in range(root.times):
            x = _unit(_solved(a, order, own[n]))
            for _ in range(2):
                for other in own[:n]:
                    x = x - ((int(x @ other) >> DIGITS) * other >> DIGITS)
                x = _unit(x)
            own[n] = x
    return [[int(c) / (1 << DIGITS) for c in x] for x in own]


def components_of(spark: SparkSession, whole: np.ndarray, number: int) -> tuple[list[int], np.ndarray]:
    """The greatest eigenvalues above 0, as whole numbers of 2**-FRACTION, and their unit vectors as columns."""
    found = greatest_roots(characteristic_polynomial(spark, whole), number)
    if not found:
        return [], np.empty((len(whole), 0))
    entries = whole.tolist()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.array(entries, object)
        for batch in batches:
            roots = [Root(int(v), int(t)) for v, t in zip(batch["value"], batch["times"])]
            yield pd.DataFrame({"place": batch["place"], "vectors": [null_vectors(own, r) for r in roots]})

    rows = [(i, str(r.value), r.times) for i, r in enumerate(found)]
    dealt = spark.createDataFrame(rows, "place int, value string, times int").repartition(len(rows), "place")
    vectors = {r["place"]: r["vectors"] for r in dealt.mapInPandas(work, "place int, vectors array<array<double>>").collect()}
    values = [r.value for r in found for _ in range(r.times)][:number]
    columns = [v for i in range(len(found)) for v in vectors[i]][:number]
    return values, np.array(columns).T


# -------------------------------------------------------------------- rows


class Whitening(NamedTuple):
    """n, the sums of the vectors, eigenvalues of the scatter matrix (falling, those above 0), their unit vectors as
    columns, and the trace of the matrix."""

    n: int
    sums: list[int]
    values: list[int]
    vectors: np.ndarray
    trace: int


def fitted(rows: DataFrame, width: int, number: int) -> Whitening:
    """The whitening of rows (vec_id, vector). Moving all vectors alike changes nothing but the sums."""
    n, sums, products = moments(rows, width)
    s = np.array(sums, object)
    scatter = n * products - np.outer(s, s)
    values, vectors = components_of(rows.sparkSession, scatter, number)
    return Whitening(n, sums, values, vectors, int(sum(scatter.diagonal())))


def _squares(off: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if int(np.abs(off).max(initial=0)) < 1 << 52 and off.shape[1] <= 64:
        high, low = off >> 24, off & (1 << 24) - 1
        parts = [np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
        return [(a << 48) + (b << 25) + c for a, b, c in zip(*parts)]
    return [sum(c * c for c in row) for row in off.tolist()]


def whiten(rows: DataFrame, fit: Whitening) -> DataFrame:
    """Stored rows (vec_id, deviation_digits, whitened): one array for each vector."""
    n, sums = fit.n, fit.sums
    width = len(sums)
    scales = np.array([math.sqrt(v / (1 << FRACTION)) for v in fit.values])
    projection = fit.vectors / scales if len(scales) else fit.vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = n.bit_length() + MOST.bit_length() < 63
        s = np.array(sums, np.int64 if small else object)
        for batch in batches:
            own = matrix(batch.column(1), width)
            off = (own if small else own.astype(object)) * n - s
            digits = _squares(off) if small else [int(row @ row) for row in off]
            found = off.astype(np.float64) @ projection
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(x) for x in digits], pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
                ["vec_id", "deviation_digits", "whitened"],
            )

    return store(rows.mapInArrow(work, "vec_id long, deviation_digits string, whitened array<double>"))


def identity_error(rows: DataFrame, number: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    if not number:
        return 0.0
    each = [F.col("whitened")[i] for i in range(number)]
    means = rows.agg(*[F.avg(w).alias(f"m{i}") for i, w in enumerate(each)]).first()
    off = [w - F.lit(means[i]) for i, w in enumerate(each)]
    pairs = [(i, j) for i in range(number) for j in range(i, number)]
    found = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_digits string"
)


def whitened(
    vectors: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits), one for each vector
    that takes part and each of the first components.

    Adding ``OFFSET`` to every entry moves all vectors alike, so deviations, components and projections are those without it.
    """
    spark = vectors.sparkSession
    width = dimension_of(vectors, column)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = store(whole_vectors(vectors.where(F.size(column) == width), id, column, scale, MOST))
    fit = fitted(rows, width, components)
    found = whiten(rows, fit)
    explained = [v / (fit.trace << FRACTION) for v in fit.values]
    number = min(components, width)
    explained += [0.0] * (number - len(explained))
    error = identity_error(found, len(fit.values))
    each = found.select("vec_id", "deviation_digits", "whitened", F.posexplode(F.array(*map(F.lit, explained))).alias("at", "explained"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.expr("try_cast(deviation_digits AS bigint)").alias("deviation"), F.get("whitened", "at").alias("whitened"),
        "explained", F.lit(error).alias("identity_error"), "deviation_digits",
    )
