"""The registered queries on odd tables, next to their SQL or to brute force."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from linkgauge.llm import queries

from . import brute, tables

NAMES = list(queries.queries())
DOCS = [(r[0], r[1]) for r in tables.documents()]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def run(spark, folder, name):
    return queries.queries()[name](spark, folder)


@pytest.mark.parametrize("name", [n for n in queries.oracle_sql() if n != "op9_substring_dedup"])
def test_against_sql(spark, odd, name):
    database = duckdb.connect()
    for table in tables.TABLES:
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    result = database.sql(queries.oracle_sql()[name])
    got = rows_of(run(spark, odd, name).select(*result.columns))
    expected = sorted(result.fetchall(), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        numbers = [x for x in b if isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx(numbers)
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    frame = run(spark, empty, name)
    rows = frame.collect()
    assert len(rows) == (1 if name == "op4_chat_format" else 0)


def test_clusters_of_wide_vectors(spark, wide):
    database = duckdb.connect()
    database.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{wide}/embeddings.parquet/*.parquet'")
    result = database.sql(queries.oracle_sql()["op12_centroid_clusters"])
    expected = sorted(result.fetchall(), key=repr)
    assert rows_of(run(spark, wide, "op12_centroid_clusters").select(*result.columns)) == expected
    assert len(expected) == 438 and len({r[1] for r in expected}) > 5


@pytest.mark.parametrize("folder", ["odd", "wide"])
def test_whitening(spark, request, folder):
    made, width = {"odd": (tables.embeddings, 16), "wide": (tables.wide_embeddings, 64)}[folder]
    kept = [(i, v) for i, v, *_ in made() if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64)
    n, off = len(x), len(x) * x - x.sum(axis=0)
    values, vectors = np.linalg.eigh(off.T.astype(float) @ off / n**3)
    order = np.argsort(-values)[:8]
    expected = collections.defaultdict(list)
    for (i, _), d, w in zip(kept, (off**2).sum(axis=1), off / n @ vectors[:, order] / np.sqrt(values[order])):
        expected[i].append((int(d), w))
    rows = collections.defaultdict(list)
    frame = run(spark, request.getfixturevalue(folder), "op13_whitening")
    for r in frame.orderBy("component").collect():
        rows[r["vec_id"], r["deviation"]].append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["deviation_digits"] == str(r["deviation"])
        assert r["explained"] == pytest.approx(values[order][r["component"] - 1] / values.sum(), rel=1e-9)
    assert sum(map(len, rows.values())) == 8 * n
    apart = values[order][:-1] / values[order][1:] - 1
    clear = [c for c in range(8) if (c == 0 or apart[c - 1] > 1e-6) and (c == 7 or apart[c] > 1e-6)]
    assert len(clear) > 5
    for i, each in expected.items():
        for d, w in each:
            own = rows[i, d]
            for c in clear:
                assert abs(own[c * len(own) // 8]["whitened"]) == pytest.approx(abs(w[c]), abs=1e-6)


def test_sharding(spark, odd):
    rows = run(spark, odd, "op2_sharding").collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in DOCS), key=repr
    )
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert all(0 <= s < 40 for s in shards)
    assert all(sorted(own) == list(range(len(own))) for own in shards.values())
    assert rows_of(run(spark, odd, "op2_sharding")) == sorted(map(tuple, rows), key=repr)


def test_near_duplicates(spark, odd):
    assert rows_of(run(spark, odd, "op3_simhash")) == sorted(brute.near_classes(DOCS)[0], key=repr)


def test_quality(spark, odd):
    rows = [r[:4] for r in tables.documents()]
    kept = brute.quality([(t, lang, source) for _, t, lang, source in rows])
    expected = []
    for (d, t, *_), k in zip(rows, kept):
        c = brute.base_counts(t)
        expected.append((d, *c[:5], c[0] < 50 or 100 * c[4] > 50 * c[0], k))
    got = rows_of(run(spark, odd, "op5_quality_rules").drop("level", "distance"))
    assert got == sorted(expected, key=repr)
    assert 0 < sum(kept) < len(kept)


def test_pieces(spark, odd):
    from linkgauge.llm import pieces

    frame = run(spark, odd, "op6_sentencepiece")
    rows = frame.collect()
    assert all(r["round_trip"] is True for r in rows if r["token_ids"] is not None)
    assert all(r["n_tokens"] == len(r["token_ids"] or []) for r in rows)
    back = pieces.decoded(frame).select("doc_id", "text")
    assert rows_of(back) == sorted(DOCS, key=repr)


@pytest.mark.parametrize("nodes", [1 << 16, 40, 0])
def test_scores(spark, odd, monkeypatch, nodes):
    """With all contexts looked up, few of them, and none but the shorter ones; no score depends on it."""
    from linkgauge.llm import ppm

    monkeypatch.setattr(ppm, "NODES", nodes)
    got = sorted(map(tuple, run(spark, odd, "op7_lm_scoring").collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    expected = sorted(brute.scores(DOCS), key=lambda r: (str(r[0]), r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_scores_without_training_rows(spark):
    import math

    from linkgauge.llm import ppm

    held = [d for d in range(60) if brute.held_out(d)][:2]
    rows = ppm.scores(spark.createDataFrame([(held[0], "ab"), (held[1], None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_known"], r["base_score"]) for r in rows) == [(d, 0, 0.0) for d in held]
    assert sorted(r["score"] for r in rows) == pytest.approx([-3 * math.log10(256), -math.log10(256)], rel=1e-6)


def test_repeats(spark, odd):
    assert rows_of(run(spark, odd, "op9_substring_dedup")) == sorted(brute.repeat_rows(DOCS), key=repr)


def test_pipeline(spark, odd):
    """All stages against brute force; the text of cut documents by their words."""
    from linkgauge.llm import pieces

    docs = [r[:4] for r in tables.documents()]
    docs = [r for r, k in zip(docs, brute.quality([r[1:] for r in docs])) if k]
    tops = brute.near_classes([r[:2] for r in docs])[1]
    first = {}
    for r, top in sorted(zip(docs, tops), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(top, r)
    docs = list(first.values())
    cut = [[w for w, c in zip(*x) if not c] for x in brute.repeat_cover([r[:2] for r in docs])]
    rate = brute.rates([(r[3], len(own)) for r, own in zip(docs, cut)])
    # what is left of a text between its words, which draws depend on, is taken from the stage
    left = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, odd)
    left = left.select("doc_id", "text", "source").collect()
    assert sorted(((r[0], " ".join(brute.words(r[1])), r[2]) for r in left), key=repr) == sorted(
        ((r[0], " ".join(own), r[3]) for r, own in zip(docs, cut)), key=repr
    )
    seen, expected = collections.Counter(), []
    for r in left:
        expected += [(r[0], " ".join(brute.words(r[1])))] * brute.copies(r[0], r[1], seen[r], rate[r[2]])
        seen[r] += 1
    expected.sort(key=repr)
    out = pieces.decoded(corpus_pipeline.run(spark, odd)).select("doc_id", "text").collect()
    assert sorted(((d, " ".join(brute.words(t))) for d, t in out), key=repr) == expected
    assert expected


def test_mix_of_repeated_and_missing_ids(spark):
    """Rows without an id, or all alike, are drawn one by one, so every source comes near its target."""
    from linkgauge.llm import mixing

    rows = [(None, f"a{i} b c d", "x") for i in range(900)] + [(7, "same words here", "y")] * 900
    rows += [(i, "some more words of text", "z") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(docs).groupBy("target").agg({"taken": "sum", "source_size": "max"}).collect()
    assert len(plan) == 3
    for r in plan:
        assert abs(r["sum(taken)"] / r["target"] - 1) < 0.1
    taken = sorted(r["taken"] for r in mixing.mix_plan(docs).collect())
    assert taken == sorted(r["taken"] for r in mixing.mix_plan(docs.repartition(2)).collect())
    words = mixing.mixed(docs).selectExpr("sum(size(split(text, ' ')))").first()[0]
    assert words == sum(taken)


def test_an_outlier_of_each_statistic_is_rejected(spark):
    """One document each of a tight group stands out by word length, symbols, repeated lines, repeated words."""
    from linkgauge.llm import quality

    rng = random.Random(8)
    def text(size=5):
        return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(12)) for _ in range(10))

    lines = [f"l{i} m{i}" for i in range(40)]
    one = text().split()
    odd = [text(12), text().replace(" ", " ## ", 60), "\n".join(lines + [text()] + lines[:30]), " ".join(one + one[:30])]
    rows = [(i, t, "en", "s") for i, t in enumerate([text() for _ in range(300)] + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judged(docs).collect()}
    assert [found[i] for i in range(300, 304)] == [(False, False)] * 4
    assert sum(found[i][0] for i in range(300)) >= 299


def test_pipeline_on_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_stages_keep_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).schema.simpleString() == docs.schema.simpleString()
