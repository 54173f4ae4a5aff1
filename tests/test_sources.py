"""Folders, mappings, the dataset store, triples."""

import pytest
from books import entity, item, loan, make_book, raw_tables, stressed_rows
from pyspark.sql import functions as F

from linkbook.functions.text import local_name
from linkbook.sources import csv_folder as C
from linkbook.sources import store, triples


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


ENTITY_HEAD = "entity_id,entity_name,counterparty_type,sector,parent_entity_id,eligible_capital,annual_revenue\n"
LOAN_HEAD = "loan_id,lender_entity_id,borrower_entity_id,exposure_amount,currency,status\n"


def test_read_book_defaults(spark, tmp_path):
    folder = put(
        tmp_path,
        entities=ENTITY_HEAD + 'E1,"Good, ""Co""",corporate,tech,,,10\n',
        loans=LOAN_HEAD + "N1,E1,E1,500,SGD,active\n",
        collateral="collateral_id,collateral_type,pledged_by_entity_id,securing_loan_id,collateral_value,haircut_pct\nC1,x,E1,N1,50,\n",
    )
    book = C.read_book(spark, folder)
    e = book.entities.first()
    assert (e.entity_name, e.parent_entity_id, e.annual_revenue, e.status) == ('Good, "Co"', None, 10, "active")
    assert book.loans.first().maturity_years == 3 and book.collateral.first().haircut_pct == 0
    assert book.guarantees.count() == book.limits.count() == 0


def test_missing_tables_and_columns(spark, tmp_path):
    with pytest.raises(C.SourceError, match="not a directory"):
        C.read_source(spark, str(tmp_path / "nowhere"))
    put(tmp_path, entities=ENTITY_HEAD + "E1,A,corporate,tech,,,\n")
    with pytest.raises(C.SourceError, match="loans.csv"):
        C.read_source(spark, str(tmp_path))
    put(tmp_path, loans="loan_id,borrower_entity_id\nN1,E1\n")
    with pytest.raises(C.SourceError, match="lender_entity_id"):
        C.read_source(spark, str(tmp_path))


def test_mapping(spark, tmp_path):
    put(
        tmp_path,
        theirs="ref,nm,type,ind\nE1,One,Corp,tech\nE2,Two,bank,fin\n",
        deals="deal,lender_ref,ref,notional,ccy,st\nN1,E2,E1,100,SGD,active\n",
    )
    (tmp_path / "m.yaml").write_text(
        "entities:\n  file: theirs.csv\n  columns: {entity_id: ref, entity_name: nm, counterparty_type: type, sector: ind}\n"
        "  value_map: {counterparty_type: {Corp: corporate}}\n"
        "loans:\n  file: deals.csv\n  columns: {loan_id: deal, lender_entity_id: lender_ref, borrower_entity_id: ref,"
        " exposure_amount: notional, currency: ccy, status: st}\n"
    )
    book = C.read_book(spark, str(tmp_path), C.load_mapping(str(tmp_path / "m.yaml")))
    assert {r.counterparty_type for r in book.entities.collect()} == {"corporate", "bank"}
    assert book.loans.first().exposure_amount == 100
    with pytest.raises(C.SourceError, match="unknown table"):
        C.parse_mapping({"bonds": {}})
    wrong = C.parse_mapping({"entities": {"file": "theirs.csv", "columns": {"entity_id": "nope"}}})
    with pytest.raises(C.SourceError, match="'nope' not found"):
        C.read_source(spark, str(tmp_path), wrong)
    partial = C.parse_mapping({"entities": {"file": "theirs.csv", "columns": {"entity_id": "ref"}}})
    with pytest.raises(C.SourceError, match="required field 'entity_name'"):
        C.read_source(spark, str(tmp_path), partial)


def test_round_trip_and_store(spark, stressed, tmp_path, monkeypatch):
    counts = C.write_book(stressed, str(tmp_path / "out"))
    assert counts == {"entities": 30, "loans": 31, "guarantees": 7, "collateral": 8, "limits": 24}
    back = C.read_book(spark, str(tmp_path / "out"))
    for table, df in stressed.tables().items():
        assert getattr(back, table).exceptAll(df).isEmpty() and df.exceptAll(getattr(back, table)).isEmpty()
    root = str(tmp_path / "store")
    store.save(stressed, root, "stressed")
    store.save(stressed, root, "calm")
    empty = stressed.with_tables(guarantees=stressed.guarantees.limit(0))
    store.save(empty, root, "calm")
    assert store.load(spark, root).guarantees.count() == 0  # calm by default, replaced whole
    assert store.load(spark, root, "stressed").guarantees.count() == 7
    monkeypatch.setenv(store.DATASET_VARIABLE, "stressed")
    assert store.dataset_name() == "stressed" and store.dataset_name("x") == "x"
    assert {r["table"]: r.rows for r in store.load_counts(stressed).collect()} == counts


def test_collateral_items_regroup(spark):
    book = make_book(spark, entities=[entity("A")], loans=[loan("1", "A", 5), loan("2", "A", 5)],
                     collateral=[item("c", "2", value=9), item("c", "1", value=9)])
    row = book.items.first()
    assert (row.collateral_id, row.n_rows, row.collateral_value) == ("c", 2, 9)


def test_triples(spark, stressed, tmp_path):
    ns = triples.Namespaces("urn:t/", "urn:i/")
    rows = triples.triples(stressed, ns)
    assert triples.distinct_triples(rows).count() == rows.count() == 811
    got = {(r.s, r.p, r.o) for r in rows.filter("s = 'urn:i/COL-3001'").collect()}
    assert ("urn:i/COL-3001", "urn:t/haircut", "0.2") in got
    assert ("urn:i/COL-3001", "urn:t/collateralValue", "6000000") in got
    assert {o for _, p, o in got if p == "urn:t/securesLoan"} == {"urn:i/LN-1001", "urn:i/LN-1006"}
    triples.write_ntriples(rows, str(tmp_path / "nt"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "nt")).collect()}
    assert len(lines) == 811
    assert '<urn:i/LN-1001> <urn:t/maturityYears> "5"^^<http://www.w3.org/2001/XMLSchema#decimal> .' in lines
    twice = stressed.with_tables(loans=stressed.loans.unionByName(stressed.loans))
    assert triples.distinct_triples(triples.triples(twice, ns)).count() == 811
    assert sum(r.triples for r in triples.triple_counts(rows).collect()) == 811


def test_literal_escapes(spark):
    df = spark.createDataFrame([("s", "p", 'a"b\\c\nd', "string")], "s string, p string, o string, kind string")
    assert df.select(triples.ntriples_line()).first()[0] == '<s> <p> "a\\"b\\\\c\\nd" .'


def test_local_name(spark):
    df = spark.createDataFrame([("http://x/y/z",), (None,), ("plain",)], "v string")
    assert [r[0] for r in df.select(local_name("v")).collect()] == ["z", "", "plain"]


def test_raw_tables_are_text(spark):
    raw = raw_tables(spark, **stressed_rows())
    assert {f.dataType.simpleString() for f in raw["loans"].schema.fields} == {"string"}


def test_a_dataset_survives_its_own_update(spark, stressed, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.save(stressed, root, "calm")
    for left in (20, 10):  # read, change, save to the same name, twice
        book = store.load(spark, root, "calm")
        store.save(book.with_tables(loans=book.loans.orderBy("loan_id").limit(left)), root, "calm")
        assert store.load(spark, root, "calm").loans.count() == left
    assert len(list((tmp_path / "store" / "dataset=calm").iterdir())) == 2  # the version before stays readable

    broken = stressed.with_tables(limits=stressed.limits.withColumn("limit_id", F.raise_error(F.lit("disk full"))))
    with pytest.raises(Exception, match="disk full"):
        store.save(broken, root, "calm")
    assert store.load(spark, root, "calm").loans.count() == 10
    store.save(stressed, root, "calm")
    assert store.load(spark, root, "calm").loans.count() == 31
    with pytest.raises(FileNotFoundError):
        store.load(spark, root, "none")


def test_headers_are_checked_without_rows(spark, tmp_path):
    (tmp_path / "entities.csv").write_text("wrong\n")
    (tmp_path / "loans.csv").write_text("wrong\n")
    with pytest.raises(C.SourceError, match="missing required"):
        C.read_source(spark, str(tmp_path))
