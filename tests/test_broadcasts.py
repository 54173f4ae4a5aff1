"""What repeats or grows with the book does not go through the driver."""

import pytest

from linkbook.catalog.queries import book_of
from linkbook.operators import contagion, scenarios

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    return book_of(spark, FOLDER)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_round_of_a_cascade_broadcasts(book, monkeypatch):
    plans = {"owing": [], "falling": []}
    stage, append = contagion.stage, contagion.Growing.append

    def staged(df, label):
        plans.setdefault(label, []).append(plan_of(df))
        return stage(df, label)

    def appended(self, rows):
        plans["falling"].append(plan_of(rows))
        return append(self, rows)

    monkeypatch.setattr(contagion, "stage", staged)
    monkeypatch.setattr(contagion.Growing, "append", appended)
    contagion.cascade_multiround(book)
    rounds = plans["owing"] + plans["falling"][1:]
    assert len(rounds) >= 4
    for plan in rounds + plans["held"]:
        assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_scenarios_do_not_broadcast_the_names(book):
    plan = plan_of(scenarios._measured_loans(book, scenarios.SCENARIOS))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_what_a_batch_names_is_found_once(spark, book, monkeypatch):
    """The report re-reads what proposals meet in the book and name in it; rows are not shuffled to look that up."""
    from linkbook.catalog.queries import proposals
    from linkbook.operators import changes

    plans, stage = {}, changes.stage

    def staged(df, label):
        plans.setdefault(label, []).append(plan_of(df))
        return stage(df, label)

    monkeypatch.setattr(changes, "stage", staged)
    changes.apply_creates(book, proposals(book))
    (report,) = plans["report"]
    assert "LeftSemi" not in report and "LeftAnti" not in report
    assert [len(plans[k]) for k in ("stored", "references", "known")] == [2, 1, 2]
