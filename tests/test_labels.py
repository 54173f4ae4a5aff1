"""Interval labels, deep books and the cascade's state against plain walks."""

import random
from collections import Counter, defaultdict

import pytest
from books import entity, guarantee, item, loan, make_book, random_rows
from brute import Brute
from pyspark.sql import functions as F

from linkbook.operators import contagion, exposure, labels, ownership


def _walk(parent, e):
    seen = []
    while e is not None and e not in seen:
        seen.append(e)
        e = parent.get(e)
    return seen, e


def _forest(seed, n, cycles):
    rng = random.Random(seed)
    names = [f"E{i:03d}" for i in range(n)]
    parent = {x: rng.choice([None, *names[max(0, i - 4) : i]]) if i else None for i, x in enumerate(names)}
    parent["E005"] = "GONE"
    if cycles:
        parent["E000"] = names[n - 1]
        parent["E001"] = "E001"
        parent.update({f"R{i}": f"R{(i + 1) % 5}" for i in range(5)}, T1="R3", T2="T1")
    return parent


@pytest.mark.parametrize("cycles", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_labels(spark, seed, cycles):
    parent = _forest(seed, 60, cycles)
    book = make_book(spark, entities=[entity(e, p) for e, p in parent.items()])
    walks = {e: _walk(parent, e) for e in parent}
    nodes = {r.node: r for r in book.labels.nodes.collect()}
    assert set(nodes) == set(parent) | {"GONE"}
    assert sorted(r.enter for r in nodes.values()) == list(range(len(nodes)))
    for e, (path, _) in walks.items():
        for head in nodes:
            assert (nodes[head].low <= nodes[e].enter < nodes[head].high) == (head in path), (e, head)
    sizes = Counter(h for path, _ in walks.values() for h in path)
    assert {r.head: r.members for r in ownership.group_sizes(book).collect()} == sizes
    got = {(r.member, r.head, r.depth) for r in labels.listing(book.labels).collect()}
    assert got == {(e, h, d) for e, (path, _) in walks.items() for d, h in enumerate(path)}
    got = {r.entity_id: (r.ubo, r.cyclic) for r in labels.owners(book.labels).collect()}
    assert got == {e: (again or path[-1], again is not None) for e, (path, again) in walks.items()}
    found = {r.entity_id: (r.cycle_id, r.length, r.distance, r.entry) for r in ownership.cycles(book).collect()}
    expected = {}
    for e, (path, again) in walks.items():
        if again is not None:
            loop = path[path.index(again) :]
            expected[e] = (min(loop), len(loop), path.index(again), again)
    assert found == expected


def test_sums_and_common_owners(spark):
    parent = _forest(3, 50, True)
    book = make_book(spark, entities=[entity(e, p) for e, p in parent.items()])
    rng = random.Random(1)
    values = {e: rng.randrange(100) for e in parent if rng.random() < 0.7}
    rows = spark.createDataFrame(list(values.items()), "node string, v long")
    paths = {e: _walk(parent, e)[0] for e in parent}
    sums = {r.node: r.v for r in labels.group_sums(book.labels, rows, ["v"]).collect()}
    for head in sums:
        assert sums[head] == sum(v for e, v in values.items() if head in paths[e])
    pairs = spark.createDataFrame([(a, b) for a in parent for b in parent], "a string, b string")
    met = {(r.a, r.b): r.owner for r in labels.common_owners(book.labels, pairs, "a", "b").collect()}
    nodes = {r.node: r for r in book.labels.nodes.collect()}
    for a in parent:
        for b in parent:
            common = [h for h in paths[a] if h in paths[b]]
            off_cycle = [h for h in common if not nodes[h].on_cycle]
            if off_cycle:  # the deepest one is met first on the way up
                assert met[a, b] == off_cycle[0]
            elif common:
                assert nodes[met[a, b]].on_cycle if (a, b) in met else nodes[a].cycle is not None
            else:
                assert (a, b) not in met


@pytest.mark.parametrize("packages", [False, True])
@pytest.mark.parametrize("seed", [4])
def test_deep_books_give_the_same(spark, monkeypatch, seed, packages):
    rows = random_rows(seed, packages=packages)
    if not packages:  # no loan behind two items
        rows["collateral"] = list({c[3]: c for c in rows["collateral"]}.values())
    rows["loans"].append(loan("NX", "NOBODY", 7000))
    rows["guarantees"] += [guarantee("GX", "NOWHERE", "N1", 5000), guarantee("GY", "NOBODY", "N2", 3000)]
    parent = {e[0]: e[4] for e in rows["entities"]}
    rows["entities"] += [entity("P", "Q"), entity("Q", "P"), entity("PP", "P"), entity("D", "GONE")]
    rows["loans"] += [loan("N_P", "P", 1000), loan("N_PP", "PP", 500), loan("N_D", "D", 250)]
    rows["guarantees"] += [guarantee("GP", "PP", "N_P", 40), guarantee("GQ", "Q", "N_PP", 30), guarantee("GD", "D", "N_P", 20)]
    shallow = make_book(spark, **rows)
    assert not shallow.deep and parent
    heads = shallow.entities.select(F.col("entity_id").alias("head"))

    def results(book):
        out = {mode: exposure.connected_exposure(book, mode) for mode in exposure.STATUS_MODES}
        out |= {"breakdown": exposure.breakdown(book, heads), "chains": exposure.guarantee_chains(book), "closure": ownership.closure(book).withColumn("depth", F.col("depth").cast("int"))}
        out |= {"sizes": ownership.group_sizes(book), "ubo": ownership.ultimate_parents(book), "cascade": contagion.cascade(book)}
        return {k: Counter(map(tuple, v.collect())) for k, v in out.items()}

    wanted = results(shallow)
    monkeypatch.setattr(ownership, "LONGEST_PATH", 2)
    deep = make_book(spark, **rows)
    assert deep.deep and "path" not in deep.ownership.columns
    for name, got in results(deep).items():
        assert got == wanted[name], name


def test_long_chain_takes_linear_rows(spark):
    """A chain of a thousand owners: connected exposure moves rows by facts, not by owners above them."""
    n = 1000
    es = spark.range(n).select(
        F.format_string("C%06d", "id").alias("entity_id"), F.when(F.col("id") > 0, F.format_string("C%06d", F.col("id") - 1)).alias("parent_entity_id")
    )
    tagged = labels.labelled(es)
    assert len(tagged.levels) == 10
    assert sum(level.count() for level in tagged.levels) <= 10 * n
    top = tagged.nodes.filter("parent is null").first()
    assert (top.size, top.members, top.enter) == (n, n, 0) and tagged.nodes.agg(F.max("depth")).first()[0] == n - 1
    rows = {
        "entities": [entity(f"C{i}", f"C{i - 1}" if i else None) for i in range(n)],
        "loans": [loan(f"N{i}", f"C{i}", 10) for i in range(0, n, 10)],
        "guarantees": [guarantee(f"G{i}", f"C{n - 1 - i}", f"N{i}", 1) for i in range(0, n, 100)],
        "collateral": [item("I", f"N{i}") for i in range(0, n, 50)],
    }
    book = make_book(spark, **rows)
    assert book.deep and "owner_pairs" not in book.__dict__
    got = {r["head"]: (r.direct, r.guarantees_given, r.shared_collateral) for r in exposure.connected_exposure(book).collect()}
    assert "owner_pairs" not in book.__dict__  # no pair of entity and owner was listed
    brute = Brute({**rows, "limits": []})
    for head in ("C0", "C1", "C499", "C500", "C620", "C990"):
        k = int(head[1:])
        inside = lambda e, k=k: int(e[1:]) >= k
        direct = sum(10 for i in range(0, n, 10) if i >= k)
        given = sum(1 for i in range(0, n, 100) if inside(f"C{n - 1 - i}") and i < k)
        touched = any(i >= k for i in range(0, n, 50))
        shared = sum(10 for i in range(0, n, 50) if i < k) if touched else 0
        assert got.get(head, (0, 0, 0)) == (direct, given, shared)
    assert brute.parent["C1"] == "C0"


def test_cascade_state_is_by_group(spark):
    """Rows of the state: one for each failed group, and for a single entity of a group that stands."""
    wide, es, ls, gs = 40, [], [], []
    for g in range(6):
        es += [entity(f"T{g}")] + [entity(f"T{g}M{i}", f"T{g}") for i in range(wide)]
        ls += [loan(f"L{g}_{i}", f"T{g}M{i}", 1000) for i in range(wide)]
    gs += [guarantee(f"G{g}", f"T{g + 1}", f"L{g}_0", 900_000) for g in range(4)]  # group after group
    gs += [guarantee("S0", "T5M3", "L0_1", 900_000), guarantee("S1", "T5", "L3_1", 900_000)]  # an entity, later its group
    book = make_book(spark, entities=es, loans=ls, guarantees=gs)
    failed, shared, _ = contagion.cascade_state(book)
    brute = Brute({"entities": es, "loans": ls, "guarantees": gs, "collateral": [], "limits": []})
    sets = defaultdict(set)
    for r in failed.collect():
        (sets[r.seed].add if r.sign > 0 else sets[r.seed].discard)(r.unit)
    assert sets["T0"] == {f"T{g}" for g in range(6)}  # the single entity is part of its group in the end
    rows = {r["seed"]: r["count"] for r in failed.groupBy("seed").count().collect()}
    assert rows["T0"] == 6 + 2 and rows["T5"] == 1
    many = {r.seed: (r.rounds, r.defaulted, r.second_order) for r in contagion.cascade_multiround(book).collect()}
    assert many == {s: brute.multiround(s)[:3] for s in brute.heads()}


def test_seeds_with_equal_sets_share_a_run(spark):
    names = ["A", "B", "C", "D", "E"]
    gs = [guarantee("G1", "B", "LA", 99_000), guarantee("G2", "A", "LB", 99_000), guarantee("G3", "C", "LA", 99_000),
          guarantee("G4", "C", "LB", 99_000), guarantee("G5", "D", "LC", 99_000), guarantee("G6", "E", "LD", 99_000)]
    rows = {"entities": [entity(x) for x in names], "loans": [loan(f"L{x}", x, 1000) for x in names], "guarantees": gs}
    book = make_book(spark, **rows)
    failed, shared, _ = contagion.cascade_state(book)
    assert [tuple(r) for r in shared.collect()] == [("B", "A")]
    assert {r["seed"]: r["count"] for r in failed.groupBy("seed").count().collect()}["B"] < 5
    brute = Brute({**rows, "collateral": [], "limits": []})
    many = {r.seed: (r.rounds, r.defaulted, r.second_order) for r in contagion.cascade_multiround(book).collect()}
    assert many == {s: brute.multiround(s)[:3] for s in names}
    closure = {r.seed: r.defaulted for r in contagion.cascade_multiround(book, contagion_group="closure").collect()}
    assert closure == {s: v[1] for s, v in many.items()}
