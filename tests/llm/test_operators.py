"""What the operators do beside their queries."""

import collections
import math
import random
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkgauge.llm import chat, common, mixing, pieces, quality, sharding, simhash, substring, topk, urlfilter

from . import brute, tables


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# ------------------------------------------------------------------- simhash


def near_prints(n, seed=1):
    """Fingerprints of which many are chains and clusters of near ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        x = rng.choice(out[:200])
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("limit", [4, 64, 4096])
def test_long_runs_are_split_without_loss(spark, limit):
    prints = near_prints(500)
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                up[top(a)] = top(b)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, first long")
    found = simhash.components(simhash.edges(nodes, 4, limit)).collect()
    root = {r["node"]: r["root"] for r in found}
    got = collections.defaultdict(set)
    for s, p in zip(signed, prints):
        got[root.get(s, s)].add(p)
    expected = collections.defaultdict(set)
    for p in prints:
        expected[top(p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_segments_leave_one_with_one_bit():
    assert simhash.segments(4) == [(0, 21), (21, 22), (43, 21)]
    assert [len(simhash.segments(d)) for d in range(6)] == [1, 1, 2, 2, 3, 3]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (1000, 999)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1000: 999}


# ------------------------------------------------------------------ substring


@pytest.mark.parametrize("rows_at_once", ["1", "7", "10000"])
def test_repeats_whatever_the_batches(spark, rows_at_once):
    rng = random.Random(9)
    parts = [tables.sentence(rng, n, 30) for n in (5, 14, 20, 35)]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows_at_once)
    try:
        frame = substring.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
        got = rows_of(frame.drop("spans"))
    finally:
        spark.conf.set(key, before)
    assert got == sorted(brute.repeat_rows(docs), key=repr)


def test_cut_leaves_other_blanks(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, passage, 0), (2, f"a \n\t b\n{passage}\n\n c  d ", 0), (3, "x  y\n", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.deduplicated(frame).collect()}
    assert got == {1: (passage, 0), 2: ("a \n\t b\nc  d ", len("a \n\t b\nc  d ")), 3: ("x  y\n", 5)}
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring.repeats(frame).collect()}
    assert spans == {1: [], 2: [(2, 22)], 3: []}


# ------------------------------------------------------------------- sharding


def test_edited_map_moves_little(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    records = sharding.record_sizes(docs, 512).cache()
    sizes = sharding.slot_bytes(records, 512).cache()
    old = sharding.first_map(sizes, 8).cache()
    loads = old.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r["b"] for r in loads) < 1.02 * min(r["b"] for r in loads)
    for shards in (9, 7):
        new = sharding.edited_map(sizes, old, shards).cache()
        assert new.count() == 512
        loads = new.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        assert len(loads) == shards and max(r["b"] for r in loads) < 1.1 * min(r["b"] for r in loads)
        moved = new.withColumnRenamed("shard", "to").join(old, "virtual_slot").where("shard <> to").join(sizes, "virtual_slot")
        share = moved.agg(F.sum("bytes")).first()[0] / sizes.agg(F.sum("bytes")).first()[0]
        assert share < 1.3 / min(shards, 8)


def test_map_versions(spark, tmp_path):
    one = spark.createDataFrame([(0, 1)], "virtual_slot int, shard int")
    sharding.write_map(one, str(tmp_path), 1)
    sharding.write_map(one.withColumn("shard", F.lit(2)), str(tmp_path), 2)
    assert sharding.read_map(spark, str(tmp_path)).first()["shard"] == 2
    assert sharding.read_map(spark, str(tmp_path), 1).first()["shard"] == 1


# -------------------------------------------------------------------- top-k


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(0, 60, (40, 19))), np.floor(rng.normal(5, 60, (50, 19)))
    exact = a @ b.T
    bounds = [x @ y.T for x, y in zip(topk.summaries(a), topk.summaries(b))]
    assert all((bound >= exact - 1e-6).all() for bound in bounds)
    assert all((fine <= coarse + 1e-6).all() for coarse, fine in zip(bounds, bounds[1:]))


def test_large_components(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 1.5]), (3, [-3e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [math.floor(256 * x) for x in v] + [0] * (2 - len(v)) for i, v in rows}
    exact = {j: min(max(sum(x * y for x, y in zip(q[0], q[j])), -(2**63)), 2**63 - 1) for j in (1, 2, 3)}
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(frame).orderBy("rank").collect()]
    assert got == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


# ----------------------------------------------------------------------- chat


def test_reply_trees(spark):
    """Paths of every tree against a walk over it."""
    rng = random.Random(4)
    rows = []
    for tree in range(12):
        for node in range(rng.randrange(1, 30)):
            parent = rng.randrange(max(0, node - 3), node) if node else None
            rows.append((f"t{tree}", node, parent, ("user", "assistant")[node % 2], f"m{node}", float(rng.randrange(5))))
    rows += [("cycle", 1, 2, "user", "a", 0.0), ("cycle", 2, 1, "user", "b", 0.0), ("orphan", 5, 99, "user", "c", 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    expected = []
    for tree in {r[0] for r in rows} - {"cycle"}:
        own = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in own.keys() - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own:
                path.append(own[at])
                at = own[at][2]
            paths.append((-sum(r[5] for r in path) / len(path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(paths)[:2], 1):
            expected.append((tree, rank, chat.render([r[3:5] for r in path])[0]))
    got = rows_of(chat.formatted(nodes, branches=2).select("tree", "rank", "formatted"))
    assert got == sorted(expected, key=repr)


def test_template_round_trip():
    turns = [("[INST] ", "<s>\\</s>\\\\[INST][/INST]"), ("", ""), ("assistant", "<"), ("assistant", "\\"), ("a ", "[/INST\\] \n <\\s>")]
    whole, mask = chat.render(turns)
    assert chat.read_back(whole) == turns
    assert [chat.unescape(whole[a : a + n]) for a, n in mask] == ["<", "\\"]


# --------------------------------------------------------------------- pieces


def test_samples_follow_the_lattice():
    model = pieces.Model()
    lattices = pieces.Lattices(model)
    weight = {model.bytes[i]: model.weights[i] for i in range(259, len(model.bytes))}

    def cuts(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in weight:
                for rest, w in cuts(text[n:]):
                    yield (text[:n], *rest), w + weight[text[:n]]

    number = 20000
    found = collections.Counter()
    for ids, counts in pieces.encode(lattices, list(range(number)), [b"then"] * number):
        at = 0
        for n in counts.tolist():
            found[tuple(model.bytes[i] for i in ids[at : at + n].tolist())] += 1
            at += n
    every = {cut: math.exp(w) for cut, w in cuts(b" then")}
    total = sum(every.values())
    assert set(found) <= set(every)
    for cut, p in every.items():
        assert abs(found[cut] / number - p / total) < 0.015


def test_pieces_do_not_depend_on_partitions(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert rows_of(pieces.encoded(docs.coalesce(1))) == rows_of(pieces.encoded(docs.repartition(7)))


# --------------------------------------------------------------------- mixing


def test_mix_emits_what_it_plans(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    plan = mixing.mix_plan(docs)
    words = mixing.mixed(docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]
    assert plan.where("taken > 2 * size").count() == 0
    rows = [(r[3], len(brute.words(r[1]))) for r in tables.documents()]
    expected = brute.rates(rows)
    got = {r["source"]: r["rate"] for r in mixing.targets(mixing.sizes_of(docs)).collect()}
    assert got == pytest.approx(expected)


# ----------------------------------------------------------------------- urls


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/x/y")], "page_id long, url string")
    rules = urlfilter.rule_table(spark, [("allow", "org", "/x/"), ("block", "b.org", "/x"), ("block", "org", "/x/y")])
    got = urlfilter.judge(pages, rules).first()
    assert (got["rule"], got["verdict"]) == ("b.org/x", "block")


def test_building_lattices_takes_little_memory():
    import tracemalloc

    lattices = pieces.Lattices(pieces.Model())
    parts = {f" word{i * 7919:x}".encode() for i in range(30_000)}
    tracemalloc.start()
    try:
        lattices.add(parts)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most - held < 25e6


# --------------------------------------------------------------------- memory


def test_a_task_counts_texts_once(spark, odd, capsys):
    """Otherwise each task keeps two Python workers, which later stages find grown."""
    kept = quality.accepted(spark.read.parquet(f"{odd}/documents.parquet"))
    capsys.readouterr()
    kept.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_functions_of_columns_give_memory_back(spark, monkeypatch):
    def doubled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield 2 * x

    double = F.pandas_udf(common.frugal(doubled), "long")
    assert rows_of(spark.range(5).select(double("id"))) == [(0,), (2,), (4,), (6,), (8,)]
    released = []
    monkeypatch.setattr(common.gc, "collect", lambda: released.append(1))
    for column, values in ((quality._counts, [b"a b", None]), (lambda: substring.packed(F.col("text")), [b"a b", None])):
        made = []
        monkeypatch.setattr(F, "pandas_udf", lambda f, kind, own=F.pandas_udf, made=made: made.append(f) or own(f, kind))
        column()
        assert len(list(made[0](iter([pd.Series(values)])))) == 1
    assert len(released) == 2
