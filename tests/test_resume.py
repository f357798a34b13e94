"""Jobs whose driver stops between steps, or tries a step again."""

import uuid

import pytest

import linkgauge as lg
from linkgauge.operators import pagerank as ranks
from linkgauge.operators import paths
from linkgauge.plans import ledger as module
from linkgauge.plans.ledger import Ledger
from tests import brute
from tests.test_paths import scores

ROWS = "key long, x long"


class Lost(Exception):
    pass


def job():
    return f"test-{uuid.uuid4().hex}"


def after(steps, monkeypatch, before_entry=False):
    """Lose the driver after so many steps, before or after the last one's entry is there."""
    enter, left = Ledger._enter, [steps]

    def entering(self, name, entry):
        counted = entry["path"] is not None and name.startswith(("batch-", "round-"))
        left[0] -= counted
        if left[0] <= 0 and counted and before_entry:
            raise Lost
        enter(self, name, entry)
        if left[0] <= 0 and counted:
            raise Lost

    monkeypatch.setattr(Ledger, "_enter", entering)


def test_a_repeated_step_counts_once(spark):
    ledger = Ledger(spark)
    for _ in range(2):
        with ledger.step("batch-0") as attempt:
            attempt.add(spark.createDataFrame([(1, 1)], ROWS))
    with pytest.raises(Lost):
        with ledger.step("batch-1") as attempt:
            attempt.add(spark.createDataFrame([(2, 1)], ROWS))
            raise Lost
    with ledger.step("batch-2"):
        pass
    assert [tuple(r) for r in ledger.read(ROWS, "batch-").collect()] == [(1, 1)]
    assert set(ledger.entries()) == {"batch-0", "batch-2"}
    assert ledger.read(ROWS, "other-").isEmpty() and Ledger(spark).entries() == {}


def test_notes_and_tables_stay_as_first_written(spark):
    name = job()
    assert Ledger(spark, name).note("n", lambda: [1, 0.1]) == [1, 0.1]
    assert Ledger(spark, name).note("n", lambda: 2) == [1, 0.1]
    assert Ledger(spark, name).table("t", lambda: spark.range(3)).count() == 3
    assert Ledger(spark, name).table("t", lambda: spark.range(4)).count() == 3


@pytest.mark.parametrize("before_entry", [False, True])
def test_betweenness_goes_on_where_it_stopped(graph_of, monkeypatch, before_entry):
    links = brute.hanging_links(30, 12, 2)
    graph, name, options = graph_of(links), job(), {"partitions": 2, "batch_rows": 60}
    with monkeypatch.context() as lost:
        after(2, lost, before_entry)
        with pytest.raises(Lost):
            scores(graph, job=name, **options)
    searched, batch = [], paths._Batch.__init__

    def searching(self, step, *rest):
        searched.append(step)
        batch(self, step, *rest)

    monkeypatch.setattr(paths._Batch, "__init__", searching)
    # another driver, with room for all sources at once, still keeps the first one's batches
    found = scores(graph, job=name, partitions=3, batch_rows=10**6)
    assert found == pytest.approx(brute.betweenness(links), abs=1e-9)
    first = searched.copy()
    assert len(first) == len(set(first)) > 0 and "batch-0" not in first
    assert scores(graph, job=name, **options) == pytest.approx(found)
    assert len(searched) == len(first)


def test_a_job_keeps_to_its_tables(graph_of, spark):
    name, ring = job(), [("a", "b"), ("b", "c"), ("c", "a")]
    lg.betweenness(graph_of(ring), job=name)
    with pytest.raises(ValueError, match="other tables"):
        lg.betweenness(graph_of([*ring, ("c", "b")]), job=name)
    with pytest.raises(ValueError, match="other tables"):
        lg.betweenness(graph_of(ring), spark.createDataFrame([("a",)], "id string"), job=name)


@pytest.mark.parametrize("before_entry", [False, True])
def test_ranks_go_on_to_the_same_bits(graph_of, monkeypatch, before_entry):
    monkeypatch.setattr(ranks, "SAVED", 3)
    graph, name = graph_of(brute.random_links(20, 50, 3)), job()
    whole = {r["id"]: r["page_rank"] for r in lg.pagerank(graph, max_iter=11).collect()}
    with monkeypatch.context() as lost:
        after(2, lost, before_entry)
        with pytest.raises(Lost):
            lg.pagerank(graph, max_iter=11, job=name)
    rounds, next_round = [], ranks._next_round
    monkeypatch.setattr(ranks, "_next_round", lambda *a, **k: rounds.append(1) or next_round(*a, **k))
    found = {r["id"]: r["page_rank"] for r in lg.pagerank(graph, max_iter=11, job=name, partitions=3).collect()}
    assert found == whole
    assert len(rounds) == 1 + 11 - (3 if before_entry else 6)
    with pytest.raises(ValueError, match="other settings"):
        lg.pagerank(graph, max_iter=12, job=name)


def test_the_first_entry_stays(spark):
    ledger = Ledger(spark)
    ledger._enter("n", {"path": None, "value": 1})
    ledger._enter("n", {"path": None, "value": 2})
    assert ledger.entries()["n"]["value"] == 1
    assert module.ENTRY not in "".join(ledger.entries())
