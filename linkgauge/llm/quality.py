"""Quality rules with robust multivariate outliers.

Base rules reject short and repetitive texts. Of the rest, statistics of each text are transformed and
compared with a minimum-covariance-determinant estimate of the text's language and source: a text
whose Mahalanobis distance is too great is rejected.

The estimate starts from medians and quartiles, which is deterministic, and takes concentration steps: the
share ``SUPPORT`` of a group that lies nearest to the present centre gives the next centre and covariance, which can only lower the
determinant. Groups too small for an estimate are pooled by language, then over all languages.

Scale: texts are read once, to a narrow table. Each step aggregates that table by group with partial
sums, so a group with a third of all rows is no hot key; quantiles are mergeable sketches. The table of
estimates has a row per group and is broadcast only if it is counted to be short.

Defined cases: a null text has no words and fails the base rules. Null languages and sources are groups. Rows that repeat are
judged each. Small groups are pooled with other small ones; if these are too few together, the base rules alone decide for them. An empty table
gives an empty result. ``accepted`` carries all columns along whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, frugal, store

SYMBOLS = b"#*$%&|<>"
#: Bytes of UTF-8 that don't begin a character.
FOLLOWING = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
#: Percent of words in repeated windows beyond which a text fails.
MOST_REPEATED = 50
WINDOW = 3

#: Share of a group that the estimate rests on.
SUPPORT = 0.6
#: Rows that a group needs for an estimate of its own.
LEAST_ROWS = 30
#: Steps end when no group's log determinant falls by this below the least it had.
CLOSE = 1e-3
#: Relative error of the quantile sketch is 1 / ACCURACY.
ACCURACY = 10_000
#: Probability that a normal vector lies beyond the cut.
TAIL = 1e-9
#: Standard deviations that are added to those found, so that constant statistics don't make every other value an outlier.
FLOORS = {"word_length": 0.05, "symbols": 0.03, "dup_lines": 0.05, "repeats": 0.05}
FEATURES = list(FLOORS)
BROADCAST_GROUPS = 50_000


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    solid = text.translate(None, BLANKS)
    chars = len(solid.translate(None, FOLLOWING))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    """Words covered by windows of three words that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= twice
    return int(covered.sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([base_counts(t) for t in texts], columns=COUNTS, dtype="int64")


def _transformed(rows: DataFrame) -> DataFrame:
    """Rows with a column ``counts`` get the base counts, base_failed and the statistics."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumns({c: F.col(f"counts.{c}") for c in COUNTS}).drop("counts").withColumns({
        "base_failed": failed,
        "word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    })


def _counts() -> Column:
    """The base counts of each text, found once.

    A filter on them would be moved below a deterministic function's column, and texts counted once for it and once for the rows left,
    in two Python workers for each task.
    """
    count = F.pandas_udf(frugal(_counted), ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()
    return count(F.col("text").cast("binary")).alias("counts")


def _group() -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ("lang", "source")]


def statistics(documents: DataFrame) -> DataFrame:
    """Stored rows (doc_id, lang, source, the base counts, base_failed, the transformed statistics)."""
    return store(_transformed(documents.select("doc_id", *_group(), _counts())))


# --------------------------------------------------------------- estimates


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi2_cdf(middle, dof) > 1 - p else (low, middle)
    return high


#: Squared distances beyond this are outliers.
CUT = chi2_quantile(1 - TAIL, len(FEATURES))
#: What the covariance of the nearest SUPPORT of normal rows is too small by.
CONSISTENCY = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, len(FEATURES)), len(FEATURES) + 2)
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
CENTRES = [f"centre_{f}" for f in FEATURES]
INVERSE = [f"inverse_{i}{j}" for i, j in PAIRS]
ESTIMATE = ", ".join(["level int", "lang string", "source string", *[f"{c} double" for c in CENTRES + INVERSE], "volume double"])


def levels(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Stored rows (lang, source, level): which group judges them, null where none can.

    Level 2: the language and source itself. Level 1: the small sources of a language together. Level 0: the
    small languages together.
    """
    counts = rows.where("NOT base_failed").groupBy("lang", "source").count()
    counts = counts.withColumn("level", F.when(F.col("count") >= least, 2))
    small = counts.where("level IS NULL").groupBy("lang").agg(F.sum("count").alias("pool"))
    rest = small.where(F.col("pool") < least).agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("rest"))
    pools = small.withColumnRenamed("lang", "pool_lang")
    each = counts.join(pools, F.col("lang").eqNullSafe(F.col("pool_lang")), "left").join(F.broadcast(rest))
    level = F.coalesce("level", F.when(F.col("pool") >= least, 1), F.when(F.col("rest") >= least, 0))
    return store(each.select("lang", "source", level.alias("level")))


def with_level(rows: DataFrame, level: DataFrame) -> DataFrame:
    """Rows with level, group_lang and group_source of the group that judges them."""
    at = level.toDF("at_lang", "at_source", "level")
    at = F.broadcast(at) if level.count() <= BROADCAST_GROUPS else at
    same = F.col("lang").eqNullSafe(F.col("at_lang")) & F.col("source").eqNullSafe(F.col("at_source"))
    return rows.join(at, same, "left").drop("at_lang", "at_source").withColumns({
        "group_lang": F.when(F.col("level") >= 1, F.col("lang")),
        "group_source": F.when(F.col("level") == 2, F.col("source")),
    })


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Centres and inverse covariances, one row per group, from rows of means and covariances."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(FEATURES)
        for part in parts:
            matrix = np.zeros((len(part), p, p))
            for n, (i, j) in enumerate(PAIRS):
                matrix[:, i, j] = matrix[:, j, i] = part[f"c{n}"].fillna(0).to_numpy() * factor
            matrix += np.diag(np.array(list(FLOORS.values())) ** 2)
            inverse = np.linalg.inv(matrix)
            out = {k: part[k] for k in ("level", "lang", "source")}
            out |= {c: part[f"m{i}"] for i, c in enumerate(CENTRES)}
            out |= {c: inverse[:, i, j] for c, (i, j) in zip(INVERSE, PAIRS)}
            yield pd.DataFrame(out | {"volume": np.linalg.slogdet(matrix)[1]})

    return store(moments.mapInPandas(work, ESTIMATE))


def _keys() -> list[Column]:
    return [F.col("level"), F.col("group_lang").alias("lang"), F.col("group_source").alias("source")]


def _first(rows: DataFrame) -> DataFrame:
    """Estimates from medians and quartiles."""
    marks = rows.groupBy(*_keys()).agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], ACCURACY).alias(f) for f in FEATURES])
    spread = [((F.col(f)[2] - F.col(f)[0]) / 1.349) for f in FEATURES]
    return _estimates(marks.select(
        "level", "lang", "source", *[F.col(f)[1].alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[(spread[i] * spread[i] if i == j else F.lit(0.0)).alias(f"c{n}") for n, (i, j) in enumerate(PAIRS)],
    ), 1.0)


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows of ``with_level`` with their squared distance, null where no estimate holds."""
    side = estimates.withColumnsRenamed({"level": "of_level", "lang": "of_lang", "source": "of_source"})
    side = F.broadcast(side) if estimates.count() <= BROADCAST_GROUPS else side
    of = (
        (F.col("level") == F.col("of_level")) & F.col("group_lang").eqNullSafe(F.col("of_lang"))
        & F.col("group_source").eqNullSafe(F.col("of_source"))
    )
    off = [F.col(f) - F.col(c) for f, c in zip(FEATURES, CENTRES)]
    square = sum((1 if i == j else 2) * F.col(c) * off[i] * off[j] for c, (i, j) in zip(INVERSE, PAIRS))
    return rows.join(side, of, "left").withColumn("distance", square).drop(*side.columns)


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates by group from rows of ``with_level``: a stored table of centres and inverse covariances."""
    rows = rows.where(F.col("level").isNotNull())
    found = _first(rows)
    before = None
    while True:
        far = with_distance(rows, found)
        cut = store(far.groupBy(*_keys()).agg(F.percentile_approx("distance", SUPPORT, ACCURACY).alias("cut")))
        side = cut.toDF("of_level", "of_lang", "of_source", "cut")
        side = F.broadcast(side) if cut.count() <= BROADCAST_GROUPS else side
        near = far.join(
            side, (F.col("level") == F.col("of_level")) & F.col("group_lang").eqNullSafe(F.col("of_lang"))
            & F.col("group_source").eqNullSafe(F.col("of_source")) & (F.col("distance") <= F.col("cut")),
        )
        moments = near.groupBy(*_keys()).agg(
            *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
            *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{n}") for n, (i, j) in enumerate(PAIRS)],
        )
        found = _estimates(moments, CONSISTENCY)
        now = found.select("level", "lang", "source", "volume")
        if before is not None:
            then = before.toDF("of_level", "of_lang", "of_source", "then")
            same = (
                (F.col("level") == F.col("of_level")) & F.col("lang").eqNullSafe(F.col("of_lang"))
                & F.col("source").eqNullSafe(F.col("of_source"))
            )
            both = now.join(then, same)
            most = both.agg(F.max(F.col("then") - F.col("volume")).alias("fall")).first()["fall"]
            if most is None or most < CLOSE:
                return found
            now = store(both.select("level", "lang", "source", F.least("volume", "then").alias("volume")))
        before = now


def _verdict(rows: DataFrame, found: DataFrame) -> DataFrame:
    near = F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return with_distance(rows, found).withColumn("kept", ~F.col("base_failed") & near)


def judged(documents: DataFrame) -> DataFrame:
    """Rows of ``statistics`` with distance and kept."""
    rows = statistics(documents)
    rows = with_level(rows, levels(rows))
    return _verdict(rows, mcd(rows.where("NOT base_failed")))


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    The texts are counted a second time where they lie, so they are not shuffled to meet their verdicts.
    """
    narrow = statistics(documents)
    level = levels(narrow)
    found = mcd(with_level(narrow, level).where("NOT base_failed"))
    rows = _transformed(documents.select(F.struct("*").alias("row"), *_group(), _counts()))
    return _verdict(with_level(rows, level), found).where("kept").select("row.*")
