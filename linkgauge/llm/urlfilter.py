"""URL rules by hashed expressions, in DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions; short hash prefixes of
these are joined with those of the rules, full digests confirm a match, and of the rules
that fit the longest wins.

Only the shapes that occur among the rules are expanded (so many host labels, so many
path characters), so the expressions of a URL are as many as the rules' shapes, however
long the URL is. Expressions of a URL are folded right after the join, in the same task,
so one narrow row per distinct (id, URL) is shuffled.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path, fits
no rule and gets the default verdict. Repeated rows are returned as often as they came.
Rules of equal length on one URL: the one with the longer host, then the blocking one. A
path is compared as it stands, so an empty path doesn't start with ``/``. An empty table
gives an empty result; columns other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import expand, lower_az

#: Hexadecimal digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table; action is ``allow`` or ``block``."""
    rows = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between ``://`` and the first ``/``, ``?`` or ``#``; then up to ``?`` or ``#``."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://(.*)\z", "$1"))
    after = F.coalesce(after, F.lit(""))
    host = lower_az(F.regexp_extract(after, r"\A[^/?#]*", 0))
    return host, F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def judge(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows (key, host, path, rule, verdict), one for each row of ``pages``."""
    order = Window.orderBy(F.length("rule"), F.length("host"), F.col("action") == "block", "rule", "action")
    known = rules.select("action", "host", "path", F.concat("host", "path").alias("rule")).withColumns({
        "rank": F.row_number().over(order),
        "labels": F.size(F.split("host", r"\.")),
        "path_chars": F.length("path"),
        "rule_digest": F.sha2("rule", 256),
    })
    shapes = sorted((r["labels"], r["path_chars"]) for r in known.select("labels", "path_chars").distinct().collect())
    digests = known.select("rank", "rule_digest", F.substring("rule_digest", 1, PREFIX_DIGITS).alias("prefix"))

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    # the URL itself goes along as an expression that fits no rule, so every row stays and is counted
    shaped = [
        F.when(
            (F.length("path") >= n) & (F.col("host") != ""),
            F.concat(F.substring_index("host", ".", -m), F.substring("path", 1, n)),
        )
        for m, n in shapes
    ]
    each = urls.select("key", "url", F.posexplode(F.array(F.coalesce("url", F.lit("")), *shaped)).alias("n", "text"))
    each = each.where(F.col("text").isNotNull()).withColumn("digest", F.sha2("text", 256))
    # its prefix is none of a rule's, so it stays one row
    prefix = F.concat(F.when(F.col("n") == 0, F.lit("-")).otherwise(F.lit("")), F.substring("digest", 1, PREFIX_DIGITS))
    each = each.select("key", "url", "n", "digest", prefix.alias("prefix"))
    fits = (F.col("n") > 0) & (F.col("digest") == F.col("rule_digest"))
    best = (
        each.join(digests, "prefix", "left")
        .groupBy("key", "url")
        .agg(F.max(F.when(fits, F.col("rank"))).alias("rank"), F.sum((F.col("n") == 0).cast("long")).alias("copies"))
        .join(known.select("rank", "rule", "action"), "rank", "left")
    )
    return expand(best, "copies", "copy").select(
        F.col("key").alias(key), host.alias("host"), path.alias("path"), "rule",
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
