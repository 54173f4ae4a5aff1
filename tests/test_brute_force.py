"""Set-based operators against one-name-at-a-time definitions on random books."""

from decimal import Decimal

import pytest
from books import entity, guarantee, item, loan, make_book, random_rows
from brute import Brute
from pyspark.sql import functions as F

from linkbook.operators import contagion, exposure, mitigation, ownership


@pytest.fixture(scope="module", params=[1, 2, 3])
def pair(request, spark):
    rows = random_rows(request.param)
    return make_book(spark, **rows), Brute(rows)


def test_connected_exposure(pair):
    book, brute = pair
    got = {
        r["head"]: (r.direct, r.guarantees_given, r.shared_collateral)
        for r in exposure.connected_exposure(book).collect()
    }
    for head in brute.parent:
        assert got.get(head, (0, 0, 0)) == brute.connected(head), head


def test_attribution_and_net(pair):
    book, brute = pair
    got = {r.owner: r.exposure for r in exposure.attributed_vector(book).collect()}
    assert got == brute.attributed()
    loan_level = exposure.risk_owners(book).groupBy("owner").agg(F.sum("exposure").alias("e"))
    assert {r.owner: r.e for r in loan_level.collect()} == got
    for r in mitigation.net_exposure(book).collect():
        assert float(r.net) == pytest.approx(brute.net(r.entity_id)), r.entity_id


def test_cascades(pair):
    book, brute = pair
    two = {r.seed: (float(r.direct_loss), float(r.contagion_loss)) for r in contagion.cascade(book).collect()}
    many = {r.seed: r for r in contagion.cascade_multiround(book).collect()}
    assert set(two) == set(many) == set(brute.heads())
    for seed in brute.heads():
        assert two[seed] == pytest.approx(brute.cascade(seed)), seed
        r = many[seed]
        rounds, n, second, loss, haircut = brute.multiround(seed)
        assert (r.rounds, r.defaulted, r.second_order, r.firesale_haircut) == (rounds, n, second, haircut), seed
        assert r.total_loss == pytest.approx(loss), seed


def test_multiround_cap(pair):
    book, brute = pair
    got = {r.seed: (r.rounds, r.defaulted) for r in contagion.cascade_multiround(book, max_rounds=2).collect()}
    assert got == {s: brute.multiround(s, cap=2)[:2] for s in brute.heads()}


def test_ownership_walks(spark):
    names = [entity("A"), entity("B", "A"), entity("X", "Y"), entity("Y", "X"), entity("T", "X"),
             entity("U", "T"), entity("S", "S"), entity("D", "GONE")]
    chain = [entity("C0")] + [entity(f"C{i}", f"C{i - 1}") for i in range(1, 151)]
    book = make_book(spark, entities=names + chain)
    ubo = {r.entity_id: r.ubo for r in ownership.ultimate_parents(book).collect()}
    assert (ubo["B"], ubo["X"], ubo["Y"], ubo["T"], ubo["U"], ubo["S"], ubo["D"]) == (
        "A", "X", "Y", "X", "X", "S", "GONE")
    assert ubo["C150"] == "C0"
    depth = ownership.closure(book).filter("member = 'C150'")
    assert depth.count() == 151 and depth.agg(F.max("depth")).first()[0] == 150
    cycles = {r.entity_id: (r.revisited_entity_id, r.on_cycle) for r in ownership.cycle_report(book).collect()}
    assert cycles == {"X": ("X", True), "Y": ("Y", True), "S": ("S", True), "T": ("X", False), "U": ("X", False)}
    reach = {(r.member, r["head"]) for r in ownership.closure(book).filter("member IN ('U', 'Y')").collect()}
    assert reach == {("U", "U"), ("U", "T"), ("U", "X"), ("U", "Y"), ("Y", "Y"), ("Y", "X")}


def test_group_variants(spark):
    book = make_book(spark, entities=[entity("A"), entity("B", "A"), entity("C", "B")])
    closed = {(r["head"], r.member) for r in ownership.group_members(book).collect()}
    assert ("B", "C") in closed
    by_ubo = {(r["head"], r.member) for r in ownership.group_members(book, "ubo").collect()}
    assert by_ubo == {("A", "A"), ("A", "B"), ("A", "C"), ("B", "B"), ("C", "C")}


def test_two_guarantors_lowest_id_decides(spark):
    rows = {
        "entities": [entity("L", kind="bank"), entity("A"), entity("B"), entity("C")],
        "loans": [loan("1", "A", 100)],
        "guarantees": [guarantee("g2", "B", "1", 100), guarantee("g1", "C", "1", 100)],
    }
    assert exposure.risk_owners(make_book(spark, **rows)).first().owner == "C"


def test_hot_item_stays_linear(spark):
    """One item over every loan: rows between stages stay near the loan count."""
    n = 400
    rows = {
        "entities": [entity("L", kind="bank")] + [entity(f"E{i}") for i in range(n)],
        "loans": [loan(f"N{i}", f"E{i}", 10) for i in range(n)],
        "collateral": [item("HOT", f"N{i}") for i in range(n)] + [item("HOT2", f"N{i}") for i in range(n)],
    }
    book = make_book(spark, **rows)
    got = exposure.connected_exposure(book)
    assert got.count() == n and {r.shared_collateral for r in got.collect()} == {10 * (n - 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "loans, items, expected",
    [
        ([("1", "A")], [("c", "1", 1000, "25")], 250),
        ([("1", "A")], [("c", "1", 2000, "25")], 0),
        ([("1", "A")], [("c", "1", None, "25")], 1000),
        ([("1", "A"), ("2", "B")], [("c", "1", 1000, "0"), ("c", "2", 1000, "0")], 1000),
        ([("1", "A"), ("2", "A", "closed")], [("c", "1", 1000, "0"), ("c", "2", 1000, "0")], 1000),
    ],
)
def test_netting(spark, loans, items, expected):
    book = make_book(
        spark,
        entities=[entity("L", kind="bank"), entity("A"), entity("B")],
        loans=[loan(x[0], x[1], 1000, *(x[2:])) for x in loans],
        collateral=[item(i, n, value=v, haircut=h) for i, n, v, h in items],
    )
    assert {r.entity_id: r.net for r in mitigation.net_exposure(book).collect()}["A"] == expected


def test_multiround_at_the_buffer(spark):
    """An obligation of exactly 30 % of the net exposure does not default the guarantor."""
    for net, owed, falls in (("3.00", "0.90", False), ("3.30", "0.99", False), ("3.00", "0.91", True)):
        book = make_book(
            spark,
            entities=[entity("S"), entity("G")],
            loans=[loan("L1", "S", 10), loan("L2", "G", Decimal(net))],
            guarantees=[guarantee("G1", "G", "L1", Decimal(owed))],
        )
        rows = {r.seed: r for r in contagion.cascade_multiround(book).collect()}
        assert (rows["S"].defaulted == 2) == falls and rows["S"].converged


def test_multiround_chain_needs_no_cap(spark):
    """A chain of guarantors falls one per round, far beyond a dozen rounds."""
    n = 20
    book = make_book(
        spark,
        entities=[entity(f"E{i}") for i in range(n)],
        loans=[loan(f"L{i}", f"E{i}", 10) for i in range(n)],
        guarantees=[guarantee(f"G{i}", f"E{i + 1}", f"L{i}", 10) for i in range(n - 1)],
    )
    whole = {r.seed: r for r in contagion.cascade_multiround(book).collect()}
    assert (whole["E0"].defaulted, whole["E0"].rounds, whole["E0"].converged) == (n, n, True)
    cut = {r.seed: r for r in contagion.cascade_multiround(book, max_rounds=3).collect()}
    assert (cut["E0"].defaulted, cut["E0"].converged) == (4, False) and cut[f"E{n - 1}"].converged


def test_wide_items_in_many_packages_stay_linear(spark):
    """Two items over every loan and a small third one: rows met later grow with the loans, not their square."""
    counts = []
    for n in (40, 80):
        rows = {
            "entities": [entity("L", kind="bank")] + [entity(f"E{i}") for i in range(n)],
            "loans": [loan(f"N{i}", f"E{i}", 10) for i in range(n)],
            "collateral": [item(x, f"N{i}") for i in range(n) for x in ("A", "B", f"S{i // 2}")],
        }
        book = make_book(spark, **rows)
        got = exposure.connected_exposure(book)
        assert {r.shared_collateral for r in got.collect()} == {10 * (n - 1)}
        links, several = exposure._shared_links(book, "full", (exposure.PRINCIPAL,))
        touch = exposure._touches(links, book, "item", (exposure.PRINCIPAL,))
        nodes = exposure._by_reach(links, touch).filter("place > 1").select("prefix", "item").distinct()
        counts.append(nodes.join(touch.select("item", "head"), "item").count())
        assert several
    assert counts[1] <= 2.1 * counts[0]
