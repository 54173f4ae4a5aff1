"""Validation, guarded import, changes, approvals, audit and access."""

import hashlib
import json

import pytest
from books import entity, guarantee, item, loan, make_book, raw_tables, stressed_rows
from pyspark.sql import functions as F

from linkbook.operators import access, audit, changes, dashboard, filters, limits, validation
from linkbook.operators.importing import import_dataset
from linkbook.sources import audit_log, store

BAD = {
    "entities": [entity("LE-1"), entity("LE-2", kind="alien")],
    "loans": [loan("LN-1", "LE-MISSING", 5_000_000, lender="LE-1"), loan("LN-2", "LE-1", -99, lender="LE-1")],
    "guarantees": [guarantee("GTY-1", "LE-1", "LN-2", 1000)],
}
GOOD = {
    "entities": [entity("B", kind="bank"), entity("H"), entity("S", "H")],
    "loans": [loan("N", "S", 5_000_000, lender="B")],
    "guarantees": [guarantee("G", "H", "N", 5_000_000)],
    "collateral": [item("C", "N", pledged="S", value=3_000_000, haircut="20")],
    "limits": [("X", "H", "25000000", "SGD")],
}


def reasons(report):
    return {(r["table"], r.record_id): r.reasons for r in report.filter("NOT accepted").collect()}


def test_bad_folder(spark, tmp_path):
    raw = raw_tables(spark, **BAD)
    report = import_dataset(spark, raw, str(tmp_path / "s"), "bad")
    assert (report.accepted, report.rejected, report.loaded, report.total) == (1, 4, False, 5)
    assert not (tmp_path / "s").exists()  # nothing written
    assert reasons(report.records) == {
        ("loans", "LN-1"): [validation.BORROWER],
        ("loans", "LN-2"): [validation.PRINCIPAL],
        ("guarantees", "GTY-1"): [validation.TWO_PARTIES],
        ("entities", "LE-2"): [validation.TYPE],
    }
    assert report.audit.first().outcome == "rejected"
    report = import_dataset(spark, raw, str(tmp_path / "s"), "bad", allow_partial=True)
    assert report.loaded
    kept = store.load(spark, str(tmp_path / "s"), "bad")
    assert [r.entity_id for r in kept.entities.collect()] == ["LE-1"] and kept.loans.count() == 0


def test_good_folder(spark, tmp_path):
    report = import_dataset(spark, raw_tables(spark, **GOOD), str(tmp_path), "mine")
    assert (report.accepted, report.rejected, report.loaded) == (7, 0, True)
    assert report.rejections().isEmpty() and report.audit.first().outcome == "accepted"
    assert store.load(spark, str(tmp_path), "mine").loans.count() == 1


def test_every_rule(spark):
    rows = {
        "entities": [entity("A"), entity("", None), entity("B", sector="")],
        "loans": [
            loan("1", "A", "x", "pending", lender="NO"), loan("2", "A", 5, lender="A"), loan("2", "A", 6, lender="A"),
            loan("3", "A", "5", lender="A"), loan("3", "A", "5.00", lender="A"),
        ],
        "guarantees": [guarantee("g", "NO", "9", 0)],
        "collateral": [item("c", "9", pledged="NO", issuer="NO", value="0", haircut="12.5"),
                       item("d", "2", pledged="A", haircut="abc"), item("e", "2", pledged="A", value=5, haircut="101")],
        "limits": [("x", "NO", "0", "SGD"), ("y", "A", "1", "SGD")],
    }
    got = reasons(validation.check_records(raw_tables(spark, **rows)))
    assert got[("entities", "(blank)")] == ["missing id"]
    assert got[("entities", "B")] == [validation.SECTOR]
    assert got[("loans", "1")] == sorted([validation.LENDER, validation.PRINCIPAL, validation.STATUS])
    assert got[("loans", "2")] == [validation.PRINCIPAL]  # two amounts under one key
    assert ("loans", "3") not in got
    assert got[("guarantees", "g")] == sorted(
        [validation.GUARANTOR, validation.GUARANTEED_LOAN, validation.GUARANTEED_AMOUNT])
    assert got[("collateral", "c")] == sorted(
        [validation.PLEDGER, validation.SECURED_LOAN, validation.ISSUER, validation.VALUE, validation.HAIRCUT])
    assert ("collateral", "d") not in got  # no value, so its haircut is not looked at
    assert got[("collateral", "e")] == [validation.HAIRCUT]
    assert got[("limits", "x")] == sorted([validation.LIMIT_AMOUNT, validation.LIMIT_ENTITY])
    loose = reasons(validation.check_records(raw_tables(spark, **rows), strict=False))
    assert ("entities", "B") not in loose and loose[("limits", "x")] == [validation.LIMIT_AMOUNT]
    assert [r.record_id for r in validation.duplicate_keys(raw_tables(spark, **rows)).collect()] == ["2", "3"]
    counted = {(r["table"], r.reason): r.records for r in validation.rejections_by_reason(
        validation.check_records(raw_tables(spark, **rows))).collect()}
    assert counted[("loans", validation.PRINCIPAL)] == 2


@pytest.fixture(scope="module")
def stress(spark):
    return make_book(spark, **stressed_rows())


def test_creates_flag_new_breaches(spark, stress):
    proposals = {
        "loans": spark.createDataFrame(
            [("LN-9", "LE-0099", "LE-0041", 30_000_000, "SGD"), ("LN-8", "LE-0099", "NOBODY", 1, "SGD"),
             ("LN-1003", "LE-0099", "LE-0001", 1, "SGD")],
            "loan_id string, lender_entity_id string, borrower_entity_id string, exposure_amount bigint, currency string"),
        "guarantees": spark.createDataFrame(
            [("G-9", "LE-0042", "LN-9", 1, "SGD")],
            "guarantee_id string, guarantor_entity_id string, beneficiary_loan_id string, amount bigint, currency string"),
    }
    new, report = changes.apply_creates(stress, proposals)
    got = {(r["table"], r.record_id): (r.accepted, r.reasons) for r in report.collect()}
    assert got == {
        ("loans", "LN-9"): (True, []), ("loans", "LN-8"): (False, [validation.BORROWER]),
        ("loans", "LN-1003"): (False, [validation.PRINCIPAL]), ("guarantees", "G-9"): (True, [])}
    added = new.loans.filter("loan_id = 'LN-9'").first()
    assert (added.status, added.maturity_years, new.loans.count(), new.guarantees.count()) == ("active", 3, 32, 8)
    flags = {(r.flag, r.subject) for r in changes.change_flags(stress, new).collect()}
    assert flags == {("limit-breach", "LE-0041")}
    assert stress.loans.count() == 31


def test_amounts(spark, stress):
    asked = spark.createDataFrame(
        [(1, "LN-1041", "principalAmount", "26000000"), (2, "LN-9999", "principalAmount", "5"),
         (3, "LIM-LE-0010", "limitAmount", "0"), (4, "bad id", "limitAmount", "5"), (5, "LN-1041", "lender", "5"),
         (6, "GTY-2001", "guaranteedAmount", "1"), (7, "LN-1041", "principalAmount", "1.5")],
        "change_id int, subject_id string, field string, new_amount string")
    new, outcome = changes.apply_amounts(stress, asked)
    got = {r.change_id: (r.accepted, r.reason) for r in outcome.collect()}
    assert got[1] == (True, "updated") and got[2] == (False, "not found") and got[6][0]
    assert got[3] == (False, validation.LIMIT_AMOUNT)
    assert {got[i][1] for i in (4, 5, 7)} == {changes.BAD_UPDATE}
    assert new.loans.filter("loan_id = 'LN-1041'").first().exposure_amount == 26_000_000
    assert {r.subject for r in changes.change_flags(stress, new).collect()} == {"LE-0041"}


def test_deactivation_and_guard(spark, stress):
    asked = spark.createDataFrame(
        [("LN-1011", "loan"), ("LE-0030", "entity"), ("GTY-2007", "guaranty"), ("COL-3002", "collateral"),
         ("LIM-LE-0001", "limit"), ("LE-0003", "entity"), ("a b", "loan"), ("LN-0", "loan")],
        "subject_id string, kind string")
    new, outcome = changes.apply_deactivations(stress, asked)
    got = {r.subject_id: (r.accepted, r.reason) for r in outcome.collect()}
    assert got["LE-0030"] == got["LE-0003"] == (False, changes.STILL_REFERENCED)
    assert got["LN-1011"][1].startswith("status set to closed") and got["GTY-2007"][1].startswith("status set to inactive")
    assert got["a b"] == (False, changes.BAD_ID) and got["LN-0"] == (False, "not found")
    watch = {r.entity_id: r for r in limits.watchlist(new).collect()}
    assert "LE-0001" not in watch and watch["LE-0030"].connected == 33_000_000
    from linkbook.operators.wrong_way import structural_wwr

    assert structural_wwr(new).isEmpty() and new.loans.count() == 31


def test_flag_records(stress):
    rows = {r.target: r for r in changes.flag_records(stress, "me").collect()}
    assert rows["LE-0030"].reason == "connected 47000000.00 >= limit 25000000.00"
    assert rows["LN-1030"].reason == "collateral COL-3002 issued by same group LE-0010 as borrower"
    assert len(rows) == 4


def test_four_eyes(spark):
    pending = spark.createDataFrame(
        [("p1", "loan", "LN-1", "ann", "rm", "pending"), ("p2", "loan", "LN-2", "ann", "rm", "approved"),
         ("p3", "loan", "LN-3", "ann", "rm", "pending"), ("p4", "limit", "X", "ann", "rm", "pending"),
         ("p5", "loan", "LN-5", "ann", "rm", "pending")],
        "id string, kind string, subject_id string, maker string, maker_role string, status string")
    decisions = spark.createDataFrame(
        [("p1", "bob", "group_risk", "approve"), ("p2", "bob", "group_risk", "approve"),
         ("p3", "ann", "group_risk", "approve"), ("p4", "bob", "rm", "approve"), ("p5", "bob", "group_risk", "reject"),
         ("p9", "bob", "group_risk", "approve")],
        "id string, checker string, checker_role string, decision string")
    resolved = changes.resolve_approvals(pending, decisions)
    got = {r.id: r.reason for r in resolved.collect()}
    assert got == {
        "p1": "approved", "p2": "no such pending change", "p9": "no such pending change",
        "p3": "four-eyes: the checker must differ from the maker", "p4": "role 'rm' may not approve changes",
        "p5": "rejected by checker"}
    assert [(r.subject_id, r.kind) for r in changes.approved_deactivations(resolved).collect()] == [("LN-1", "loan")]


def _log(n):
    prev, lines = audit.GENESIS, []
    for i in range(n):
        body = {"action": "create-loan", "target": f"LN-{i} é", "actor": "a", "role": "r", "outcome": "accepted",
                "reason": 'said "ok"', "payload": {"n": i, "entry_hash": "x"}, "flags": [], "timestamp": "t",
                "correlation_id": f"c{i}", "seq": i, "prev_hash": prev}
        digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        lines.append(json.dumps({**body, "entry_hash": digest}, sort_keys=True))
        prev = digest
    return lines


def _problems(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return {(r.seq, r.problem) for r in audit.chain_problems(df).collect()}


def test_audit_chain(spark, tmp_path):
    lines = _log(6)
    assert _problems(spark, lines) == set()
    edited = list(lines)
    edited[3] = edited[3].replace('"actor": "a"', '"actor": "z"')
    assert _problems(spark, edited) == {(3, "entry_hash mismatch (content altered)")}
    assert _problems(spark, lines[:2] + lines[3:]) == {
        (3, "seq out of order"), (3, "prev_hash does not chain")}
    assert _problems(spark, lines + [lines[5]]) == {(5, "seq out of order")}
    assert (0, "prev_hash does not chain") not in _problems(spark, lines)
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    read = audit_log.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert audit.chain_status(read).first().asDict() == {"ok": True, "problems": 0, "length": 6}
    assert audit_log.entries(spark, str(tmp_path / "a.jsonl")).filter("seq = 2").first().target == "LN-2 é"


def test_access(spark, stress):
    heads = access.candidate_groups(stress)
    everyone = access.visible_groups("group_risk", [], heads)
    assert everyone.count() == heads.count() == 21
    seen = access.visible_groups("relationship_manager", ["LE-0020", "LE-0002", "X"], heads)
    assert [r["head"] for r in seen.collect()] == ["LE-0020"]
    assert access.visible_groups("auditor", ["LE-0020"], heads).isEmpty()
    people = spark.createDataFrame(
        [("dana", "group_risk", []), ("bob", "relationship_manager", ["LE-0001", "LE-0099"]), ("eve", "x", ["LE-0001"])],
        "principal string, role string, portfolios array<string>")
    assert {(r.principal, r["head"], r.sees_all) for r in access.grants(people, heads).collect()} == {
        ("dana", None, True), ("bob", "LE-0001", False)}
    decided = people.select("principal", access.allow(F.col("role"), F.col("portfolios"), F.lit("LE-0001")).alias("ok"))
    assert {r.principal: r.ok for r in decided.collect()} == {"dana": True, "bob": True, "eve": False}


def test_dashboard_scope(spark, stress):
    seen = access.visible_groups("relationship_manager", ["LE-0020"], access.candidate_groups(stress))
    board = dashboard.dashboard(stress, seen)
    assert {r.entity_id for r in board["watchlist"].collect()} == {"LE-0020", "LE-0021", "LE-0022", "LE-0023"}
    assert [r.owner for r in board["exposures"].collect()] == ["LE-0020"] and board["wwr"].isEmpty()
    assert board["hhi"].count() == 1  # book-level metrics are not scoped
    assert dashboard.dashboard(stress)["wwr"].count() == 1


def test_scope_keeps_rows_without_ids(spark, stress):
    seen = access.visible_groups("relationship_manager", [], access.candidate_groups(stress))
    rows = spark.createDataFrame([("LE-0021", 1), (None, 2)], "entity_id string, v int")
    assert [r.v for r in access.scope_rows(rows, stress, seen).collect()] == [2]
    assert access.scope_rows(rows.select("v"), stress, seen).count() == 2


def test_limit_gate(spark):
    df = spark.createDataFrame([("limit", "rm"), ("limit", "group_risk"), ("loan", "rm")], "kind string, role string")
    assert [r.allowed for r in access.gate_limit_edits(df).collect()] == [False, True, True]


def test_filters(stress):
    watch = limits.watchlist(stress)
    assert filters.apply_filters(watch, {"band": ["red", "amber"], "entity_id": None}).count() == 7
    assert filters.apply_filters(watch, {"utilisation": (1.0, None)}).count() == 3
    assert filters.bind(watch, "entity_id", ["LE-0001"]).count() == 1
    assert filters.without(watch, watch.filter("band = 'red'"), "entity_id").count() == 21
    with pytest.raises(KeyError):
        filters.bind(watch, "nbfi", ["x"])
    with pytest.raises(KeyError):
        filters.apply_filters(watch, {"nope": 1})


def test_amounts_that_would_be_lost_or_altered(spark, tmp_path):
    amounts = {"L1": "1" + "0" * 22, "L2": "0.001", "L3": "5.00", "L4": "7.1"}
    raw = raw_tables(spark, entities=[entity("B", kind="bank"), entity("S")], loans=[loan(i, "S", a, lender="B") for i, a in amounts.items()])
    report = import_dataset(spark, raw, str(tmp_path), "mine", allow_partial=True)
    assert reasons(report.records) == {("loans", "L1"): [validation.UNFIT], ("loans", "L2"): [validation.UNFIT]}
    loaded = {r.loan_id: str(r.exposure_amount) for r in store.load(spark, str(tmp_path), "mine").loans.collect()}
    assert loaded == {"L3": "5.00", "L4": "7.10"}


def test_an_amount_too_long_is_refused(spark, stress):
    asked = spark.createDataFrame([(1, "LN-1001", "principal", "9" * 25)], "change_id int, subject_id string, field string, new_amount string")
    field = next(f for f, v in changes.AMOUNT_FIELDS.items() if v[0] == "loans")
    loan_id = stress.loans.first().loan_id
    asked = asked.withColumns({"field": F.lit(field), "subject_id": F.lit(loan_id)})
    book, outcome = changes.apply_amounts(stress, asked)
    assert [(r.accepted, r.reason) for r in outcome.collect()] == [(False, changes.BAD_UPDATE)]
    assert book.loans.exceptAll(stress.loans).isEmpty()


def test_one_limit_rule_for_subsidiaries(spark):
    """Two limits on a subsidiary count once, by the lowest id; a zero limit never breaches."""
    book = make_book(
        spark,
        entities=[entity("H"), entity("S", "H"), entity("Z", "H")],
        loans=[loan("L", "S", 100), loan("M", "Z", 100)],
        limits=[("X1", "S", "50", "SGD"), ("X2", "S", "60", "SGD"), ("X3", "Z", "0", "SGD"), ("X0", "H", "0", "SGD")],
    )
    (row,) = limits.subsidiary_breach_check(book).collect()
    listed = limits.breaching_subsidiaries(book).collect()
    assert (row.subsidiary_breaches, row.ubo_breaches) == (1, False)
    assert [(r["head"], r.entity_id) for r in listed] == [("H", "S")]


def test_dashboard_builds_the_asked_parts_only(stressed, monkeypatch):
    whole = dashboard.dashboard(stressed)
    for name in ("hhi_direct_connected", "cr_direct_connected", "sector_shares"):
        monkeypatch.setattr(dashboard.C, name, lambda book: pytest.fail("not asked for"))
    part = dashboard.dashboard(stressed, parts=("exposures",))
    assert set(part) == {"exposures"} and sorted(part["exposures"].collect()) == sorted(whole["exposures"].collect())


def test_creates_beside_stored_rows_with_blank_and_repeated_ids(spark, stress):
    """References to proposed and stored rows, to a blank id and to nothing; a key with two contents; a row without key."""
    loans = "loan_id string, lender_entity_id string, borrower_entity_id string, exposure_amount string, currency string"
    proposals = {
        "entities": spark.createDataFrame(
            [("NEW", "n", "bank", "energy"), (" ", "blank", "bank", "energy")], "entity_id string, entity_name string, counterparty_type string, sector string"),
        "loans": spark.createDataFrame(
            [("A", "LE-0099", "NEW", "5", "SGD"), ("B", "LE-0099", " ", "5", "SGD"), ("C", "LE-0099", None, "5", "SGD"),
             ("D", "LE-0099", "NEW", "5", "SGD"), ("D", "LE-0099", "NEW", "6", "SGD"), (None, "LE-0099", "NEW", "5", "SGD")], loans),
    }
    _, report = changes.apply_creates(stress, proposals)
    got = {(r["table"], r.record_id): r.reasons for r in report.collect()}
    assert got == {
        ("entities", "NEW"): [], ("entities", "(blank)"): [validation.MISSING_ID], ("loans", "(blank)"): [validation.MISSING_ID],
        ("loans", "A"): [], ("loans", "B"): [validation.BORROWER], ("loans", "C"): [validation.BORROWER], ("loans", "D"): [validation.PRINCIPAL]}
