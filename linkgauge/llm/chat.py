"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins that double the distance of an ancestor with every round give the score and
length of the path to each leaf; of a tree the leaves with the best mean score are chosen, and the same tables of ancestors, joined in turn, enumerate the
messages of the chosen paths. Each path is formatted as one conversation, with the spans of its loss mask.

Template: ``<s>[INST] role [/INST]text</s>`` for each message. A backslash escapes: it is doubled in texts and roles, and put into every
control string, so none occurs there, and taking away one of each is exact.

Scale: rounds grow with the logarithm of the longest path, shrink as paths end, and carry numbers only; texts are joined at the end, for chosen paths
alone. Only one conversation has to fit into a task.

Defined cases: a null text or role is empty. A parent that isn't there makes a root. Messages on a cycle reach no root and
belong to no path. Equal scores: the longer path, then the smaller node. Rows of one conversation with the same turn are put in the order of
role and text, and all stay. A null conversation id is a conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = re.compile(r"(<)(/?s>)|(\[)(/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
LEARNT = "assistant"
FORMATTED = "formatted string, mask array<struct<start: int, length: int>>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]], learnt: str = LEARNT) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and (start, length) of what is under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == learnt:
            mask.append((at + len(head), len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


# ------------------------------------------------------------------- trees


def from_turns(conversations: DataFrame, tree: str = "tree") -> DataFrame:
    """Stored nodes (tree, node, parent, role, text, score) of conversations whose every turn answers the one before."""
    order = Window.partitionBy(tree).orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = conversations.select(tree, node.alias("node"), "role", "text")
    return store(numbered.select(
        F.col(tree).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    ))


class Ancestors(NamedTuple):
    """What the rounds of doubling find.

    jumps  per round k, rows (tree, node, up) of the nodes with an ancestor at a distance of 2**k, which is up
    whole  rows (tree, node, total, length): sum of the scores, and number, of the nodes from the root to this one
    """

    jumps: list[DataFrame]
    whole: DataFrame


def ancestors(nodes: DataFrame) -> Ancestors:
    """A round joins only the nodes whose root is still further away, so rounds shrink as paths end."""
    known = nodes.select(F.col("tree").alias("of"), F.col("node").alias("known"))
    own = nodes.select(
        "tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")
    ).join(known, (F.col("tree") == F.col("of")) & (F.col("up") == F.col("known")), "left")
    now = store(own.select("tree", "node", F.col("known").alias("up"), "total", "length"))
    ended, jumps = [], []
    last = None
    while True:
        ended.append(now.where("up IS NULL"))
        further = now.where("up IS NOT NULL")
        left = further.count()
        # in 2**k rounds more every path ends; what is left then goes round in circles
        last = left.bit_length() + 1 if last is None else last
        if not left or len(jumps) > last:
            whole = reduce(DataFrame.union, ended)
            return Ancestors(jumps, whole.select("tree", "node", "total", "length"))
        jumps.append(further.select("tree", "node", "up"))
        above = reduce(DataFrame.union, [*ended, further]).toDF("of", "known", "next_up", "next_total", "next_length")
        joined = further.join(above, (F.col("tree") == F.col("of")) & (F.col("up") == F.col("known")))
        now = store(joined.select(
            "tree", "node", F.col("next_up").alias("up"), (F.col("total") + F.col("next_total")).alias("total"),
            (F.col("length") + F.col("next_length")).alias("length"),
        ))


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (tree, rank, length, distance, node): the best paths of every tree, distance counted from the leaf."""
    found = ancestors(nodes)
    leaves = found.whole
    if found.jumps:
        inner = found.jumps[0].select("tree", F.col("up").alias("node")).distinct()
        leaves = leaves.join(inner, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = [store(best.select("tree", "rank", "length", F.lit(0).cast("long").alias("distance"), "node"))]
    for k, jump in enumerate(found.jumps):
        # only messages that far from the root have one of these ancestors
        some = reduce(DataFrame.union, paths).where(F.col("distance") + (1 << k) < F.col("length"))
        paths.append(store(some.join(jump, ["tree", "node"]).select(
            "tree", "rank", "length", (F.col("distance") + (1 << k)).alias("distance"), F.col("up").alias("node")
        )))
    return reduce(DataFrame.union, paths)


def _formatted(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [render(list(zip(r, t))) for r, t in zip(roles, texts)]
    return pd.DataFrame({
        "formatted": [f for f, _ in rows], "mask": [[{"start": a, "length": n} for a, n in m] for _, m in rows],
    })


def formatted(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (tree, rank, formatted, mask), one for each chosen path of the stored nodes."""
    texts = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = chosen_paths(nodes, branches).join(texts, ["tree", "node"])
    turns = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("place"), "role", "text")))
    whole = path.groupBy("tree", "rank").agg(turns.alias("turns"))
    found = F.pandas_udf(_formatted, FORMATTED)(F.col("turns.role"), F.col("turns.text"))
    return whole.select("tree", "rank", found.alias("found")).select("tree", "rank", "found.*")


# --------------------------------------------------------------- read back


def digest(formatted: str, mask: Sequence[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """Number and checksum of the turns, length and checksum of the text under the mask, length of the whole."""
    turns = read_back(formatted)
    every = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(unescape(formatted[a : a + n]) for a, n in mask)
    return (
        len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(),
        len(formatted),
    )


def _digests(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    rows = [digest(t, list(zip(a, n))) for t, a, n in zip(texts, starts, lengths)]
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(conversations: DataFrame) -> DataFrame:
    """Rows (tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``formatted``."""
    found = F.pandas_udf(_digests, DIGEST)("formatted", "mask.start", "mask.length")
    return conversations.select("tree", "rank", found.alias("found")).select("tree", "rank", "found.*")
