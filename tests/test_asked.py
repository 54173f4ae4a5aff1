"""Answers for asked heads and for changes read what they concern, and are the whole answers' rows."""

import pytest
from books import entity, guarantee, item, loan, make_book, random_rows
from pyspark.sql import functions as F

from linkbook.operators import changes, exposure, labels, limits, ownership
from linkbook.operators.wrong_way import structural_wwr


@pytest.mark.parametrize("seed", [1, 6])
def test_asked_heads_get_their_rows(spark, seed):
    rows = random_rows(seed)
    rows["loans"].append(loan("NX", "NOBODY", 7000))
    book = make_book(spark, **rows)
    asked = spark.createDataFrame([("E0",), ("E2",), ("E7",), ("NOBODY",), ("ABSENT",)], "head string")
    for mode in exposure.STATUS_MODES:
        whole = exposure.connected_exposure(book, mode).join(asked, "head", "left_semi")
        assert sorted(exposure.connected_exposure(book, mode, asked).collect()) == sorted(whole.collect())


def test_asked_heads_read_their_groups_only(spark):
    """Ten times the other groups: the same rows behind the asked ones."""
    sizes = []
    for others in (10, 100):
        es, ls, cs, gs = [entity("H"), entity("M", "H")], [loan("N0", "H", 10), loan("N1", "M", 10)], [item("I", "N0")], []
        for g in range(others):
            es += [entity(f"T{g}"), entity(f"S{g}", f"T{g}")]
            ls += [loan(f"A{g}", f"S{g}", 10), loan(f"B{g}", f"T{g}", 10)]
            cs += [item(f"J{g}", f"A{g}"), item(f"J{g}", f"B{g}")]
            gs.append(guarantee(f"G{g}", f"T{g}", f"A{(g + 1) % others}", 5))
        cs.append(item("I", "A3"))
        book = make_book(spark, entities=es, loans=ls, collateral=cs, guarantees=gs)
        asked = spark.createDataFrame([("H",)], "head string")
        reach = exposure.group_reach(book, asked)
        links, _ = exposure._asked_links(book, "full", (exposure.PRINCIPAL,), reach)
        sizes.append((reach.count(), links.count()))
        row = exposure.connected_exposure(book, heads=asked).first()
        assert (row.direct, row.shared_collateral, row.connected) == (20, 10, 30)
    assert sizes == [(2, 2), (2, 2)]


def _flags(book):
    return {("limit-breach", r.entity_id) for r in limits.limit_breaches(book).collect()} | {
        ("wrong-way-risk", r.loan_id) for r in structural_wwr(book).collect()
    }


@pytest.mark.parametrize("change", ["loan", "guarantee", "item", "limit", "status", "owner", "nothing"])
def test_change_flags_are_the_difference(spark, change):
    before = make_book(spark, **random_rows(11))
    after = {
        "loan": lambda b: b.with_tables(loans=b.loans.withColumn("exposure_amount", F.when(F.col("loan_id").isin("N3", "N7"), F.col("exposure_amount") * 50).otherwise(F.col("exposure_amount")).cast("decimal(20,2)"))),
        "guarantee": lambda b: b.with_tables(guarantees=b.guarantees.withColumn("amount", (F.col("amount") * 30).cast("decimal(20,2)"))),
        "item": lambda b: b.with_tables(collateral=b.collateral.withColumn("issuer_entity_id", F.lit("E0"))),
        "limit": lambda b: b.with_tables(limits=b.limits.withColumn("single_name_limit", (F.col("single_name_limit") / 10).cast("decimal(20,2)"))),
        "status": lambda b: b.with_tables(collateral=b.collateral.filter("collateral_id <> 'C_HOT'")),
        "owner": lambda b: b.with_tables(entities=b.entities.withColumn("parent_entity_id", F.when(F.col("entity_id") == "E9", "E8").otherwise(F.col("parent_entity_id")))),
        "nothing": lambda b: b,
    }[change](before)
    got = {(r.flag, r.subject) for r in changes.change_flags(before, after).collect()}
    assert got == _flags(after) - _flags(before)
    assert change != "nothing" or not got


def test_one_changed_loan_affects_its_groups(spark):
    es, ls = [], []
    for g in range(30):
        es += [entity(f"T{g}"), entity(f"S{g}", f"T{g}")]
        ls += [loan(f"A{g}", f"S{g}", 10)]
    book = make_book(spark, entities=es, loans=ls, guarantees=[guarantee("G", "S4", "A3", 1)], collateral=[item("I", "A3"), item("I", "A9")])
    new = book.with_tables(loans=book.loans.withColumn("exposure_amount", F.when(F.col("loan_id") == "A3", 99).otherwise(F.col("exposure_amount")).cast("decimal(20,2)")))
    heads, loans = changes.affected(book, new)
    assert {r["head"] for r in heads.collect()} == {"S3", "T3", "S4", "T4", "S9", "T9"}
    assert {r["loan_id"] for r in loans.collect()} == {"A3"}
    assert changes.affected(book, book.with_tables(entities=book.entities.filter("entity_id <> 'T5'"))) is None
    assert labels and ownership
