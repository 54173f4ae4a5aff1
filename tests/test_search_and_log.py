"""The search beyond the grid, the log in file order, and saves that overlap."""

import random

import pytest
from books import entity, loan, make_book, random_rows
from pyspark.sql import functions as F

from linkbook.catalog import queries
from linkbook.operators import audit, reverse_stress
from linkbook.sources import audit_log, store


def test_search_equals_a_long_grid(spark):
    book = make_book(spark, **random_rows(2, entities=12, loans=20))
    rows = [(m, x, f) for m in reverse_stress.METRICS for x in (1.0, 1.3, 2.0, 2.5) for f in reverse_stress.FAMILIES]
    targets = spark.createDataFrame(rows, "metric string, multiple double, family string")
    grid = reverse_stress.severity_grid(book, 16)
    wanted = {(r.metric, r.family, r.target): r for r in reverse_stress.min_shock(grid, targets).collect()}
    got = {(r.metric, r.family, r.target): r for r in reverse_stress.search(book, targets, {"downgrade": 6, "exposure": 16}).collect()}
    assert set(got) == set(wanted)  # equal targets are one question
    for key, r in got.items():
        assert (r.severity, r.feasible, r.shock_label) == (wanted[key].severity, wanted[key].feasible, wanted[key].shock_label), key
        if r.feasible:
            assert r.achieved == pytest.approx(wanted[key].achieved)
    assert max(r.severity or 0 for r in got.values()) > 6  # beyond the grid's default


def test_log_in_file_order(spark, tmp_path):
    rng = random.Random(1)
    numbers = spark.range(400).select(F.col("id").alias("loan_id"))
    lines = [r.value for r in queries._audit_lines(numbers).orderBy("value").collect()]
    lines.sort(key=lambda x: int(x.split('"seq": ')[1].split(",")[0]))
    for folder, order in (("right", list(range(400))), ("swapped", [*range(10), 11, 10, *range(12, 400)])):
        at = 0
        (tmp_path / folder).mkdir()
        while at < 400:
            n = rng.randint(1, 90)
            text = "".join(lines[i] + "\n" + "\n" * rng.randint(0, 2) for i in order[at : at + n])
            (tmp_path / folder / f"part-{at:05d}.txt").write_text(text)
            at += n
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many splits a file
        try:
            numbered = audit_log.numbered_lines(spark, str(tmp_path / folder))
            assert [r.value for r in numbered.orderBy("at").collect()] == [lines[i] for i in order]
            assert sorted(r["at"] for r in numbered.collect()) == list(range(400))
            found = {(r.at, r.seq, r.problem) for r in audit.ordered_chain_problems(numbered).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        wanted = set()
        for at, s in enumerate(order):
            if s % 97 == 0:
                wanted.add((at, s, "entry_hash mismatch (content altered)"))
            if s != at:
                wanted.add((at, s, "seq out of order"))
            if not (s % 2 == 0 if at == 0 else s % 2 == 1 and order[at - 1] == s - 1):
                wanted.add((at, s, "prev_hash does not chain"))
        assert found == wanted


def _amounts(spark, root):
    return {r.exposure_amount for r in store.load(spark, root, "x").loans.collect()}


def test_overlapping_saves(spark, tmp_path):
    root = str(tmp_path)
    books = [make_book(spark, entities=[entity("A")], loans=[loan("L", "A", n)]) for n in (1, 2, 3)]
    store.save(books[0], root, "x")
    folder = f"{root}/dataset=x"
    # The first save claims its number, and writes while a second one runs through.
    early = store.claim(spark, folder)
    assert store.claim(spark, folder) != early
    for table, df in books[1].tables().items():
        df.write.parquet(f"{folder}/version={early}/{table}")
    assert {int(x) for x in _amounts(spark, root)} == {1}
    store.save(books[2], root, "x")
    assert {int(x) for x in _amounts(spark, root)} == {3}
    assert store.publish(spark, folder, early) > early
    assert {int(x) for x in _amounts(spark, root)} == {2}  # it ended last
    store.save(books[0], root, "x")
    assert {int(x) for x in _amounts(spark, root)} == {1}


def test_book_follows_its_tables(spark, tmp_path):
    for name in ("customer", "nation", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = queries.book_of(spark, str(tmp_path))
    assert queries.book_of(spark, str(tmp_path)) is first
    n = first.loans.count()
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(10).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert n > 10 and queries.book_of(spark, str(tmp_path)).loans.count() == 10


def test_search_takes_few_jobs(spark, monkeypatch):
    """The ends of the scale and lines between them find every severity in a few evaluations."""
    book = make_book(spark, **random_rows(2, entities=12, loans=20))
    value = {
        ("expected_loss", "exposure"): lambda n: max(0.0, 100.0 * (10 + n) / 10 - 70),
        ("capital", "exposure"): lambda n: 50.0 + n // 3,
        ("capital_pct_eligible", "exposure"): lambda n: 1.0 if n < 5000 else 4.0,
        ("limit_breaches", "exposure"): lambda n: min(900.0, 20 + 3 * n**0.5),
    }
    for metric in reverse_stress.METRICS:
        value[metric, "downgrade"] = lambda n: 10.0 + n * n
        value[metric, "base"] = lambda n, f=value[metric, "exposure"]: f(0)
    steps = []

    class Evaluated(list):
        def collect(self):
            return self

    def values(_, shocks):
        steps.append(len(shocks))
        at = [(f, int(n or 0)) for f, _, n in (s.key.partition(":") for s in shocks)]
        return Evaluated({"family": f, "severity": n, "metric": m, "value": value[m, f](n)} for f, n in at for m in reverse_stress.METRICS)

    monkeypatch.setattr(reverse_stress, "_values", values)
    rows = [(m, x, f) for m in reverse_stress.METRICS for x in (1.0, 1.5, 3.0, 12.0, 900.0) for f in reverse_stress.FAMILIES]
    got = reverse_stress.search(book, spark.createDataFrame(rows, "metric string, multiple double, family string")).collect()
    assert len(got) == len(rows)
    for r in got:
        tried = range(1, reverse_stress.LARGEST[r.family] + 1)
        found = next((n for n in tried if value[r.metric, r.family](n) >= r.target), None)
        assert (r.severity, r.achieved) == (found, value[r.metric, r.family](found or tried[-1]))
        assert r.searched_to == (found or tried[-1])
    assert len(steps) <= 12
