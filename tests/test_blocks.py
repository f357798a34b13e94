"""What searches in blocks keep on disk, and how they send values along links."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgauge.operators import blocks
from linkgauge.plans.loop import checkpoint, store


@pytest.mark.parametrize("number", [0, 1, 31, 32, 33, 700, 1000])
def test_cells_are_no_longer_than_a_list_or_bits(number):
    cells = np.sort(np.random.default_rng(number).choice(1000, number, replace=False))
    data = blocks.cells_out(cells, 1000)
    assert len(data) == min(4 * number, 125)
    assert blocks.cells_in(data, 1000).tolist() == cells.tolist()


@pytest.mark.parametrize("greatest, width", [(255.0, 1), (256.0, 2), (65536.0, 4), (2.0**32, 8), (2.0**60, 8), (np.inf, 8)])
def test_counts_take_as_few_bytes_as_hold_them(greatest, width):
    values = np.array([1.0, greatest, 3.0])
    data = blocks.counts_out(values)
    assert len(data) == 3 * width
    assert blocks.counts_in(data, 3).tolist() == values.tolist()
    assert blocks.counts_in(blocks.counts_out(values[:0]), 0).tolist() == []


@pytest.mark.parametrize("cells", [1, 40, 900])
@pytest.mark.parametrize("gathered", [3, 1 << 20])
def test_few_cells_are_sent_like_many(monkeypatch, cells, gathered):
    draw = np.random.default_rng(cells)
    size, width = 60, 20
    to, come_from = np.sort(draw.integers(0, size, 300)), draw.integers(0, size - 5, 300)
    own = np.sort(draw.choice(size * width, cells, replace=False))
    values = draw.integers(1, 9, cells).astype(float)
    expected = np.zeros((size, width))
    for cell, value in zip(own, values):
        np.add.at(expected[:, cell % width], to[come_from == cell // width], value)
    monkeypatch.setattr(blocks, "GATHERED", gathered)
    for singly in (0, 10**9):
        monkeypatch.setattr(blocks, "SINGLY", singly)
        found = np.zeros((size, width))
        blocks._spread(found, come_from.astype(np.uint16), to.astype(np.uint16), own, values)
        assert found.tolist() == expected.tolist()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffle_files_go_when_a_table_is_written(spark, adaptive):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        there = shuffles()
        counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        stored, kept = store(counts), checkpoint(counts)
        assert not shuffles() - there
        assert sorted(stored.collect()) == sorted(kept.collect()) == sorted(counts.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
