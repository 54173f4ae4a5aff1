"""Laws of the concentration measures on random exposure vectors."""

import random
from decimal import Decimal

import pytest
from books import loan, make_book, entity

from linkbook.operators import concentration as C
from linkbook.operators import exposure


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(7)
    rows = []
    for case in range(40):
        scale = 10 ** rng.randrange(0, 7)
        for name in range(1 if case == 0 else rng.randrange(1, 40)):
            rows.append((case, name, Decimal(rng.randrange(1, 1000) * scale)))
    rows += [(100 + c, n, e * 7) for c, n, e in rows]
    df = spark.createDataFrame(rows, "case int, name int, exposure decimal(30,2)")
    sizes = {}
    for c, _, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    return df, sizes


def test_hhi_and_ratio_bounds(vectors):
    df, sizes = vectors
    h = {r.case: r.hhi for r in C.hhi(df, ("case",)).collect()}
    c = {r.case: r.ratio for r in C.top_k_ratio(df, 10, ("case",)).collect()}
    for case, n in sizes.items():
        assert 1 / n - 1e-9 <= h[case] <= 1 + 1e-9
        assert 0 < c[case] <= 1 + 1e-9
        if n == 1:
            assert h[case] == pytest.approx(1)
        if n <= 10:
            assert c[case] == pytest.approx(1)
        assert h[case] == pytest.approx(h[(case + 100) % 200])


def test_top_k_is_limited_before_the_shuffle(vectors):
    plan = C.top_k(vectors[0], 3, ("case",))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_empty_book_is_zero(spark):
    book = make_book(spark, entities=[entity("A")], loans=[loan("1", "A", 5, "closed")])
    assert C.hhi_direct_connected(book).first().asDict() == {"direct_hhi": 0.0, "connected_hhi": 0.0}
    assert C.cr_direct_connected(book).first().asDict() == {"direct_cr": 0.0, "connected_cr": 0.0}
    assert C.top_bucket(C.sector_shares(book)).first().bucket == "-"
    assert exposure.attributed_vector(book).count() == 0


def test_closed_loans_drop_out(spark):
    rows = [loan("1", "A", 5), loan("2", "A", 7, "closed")]
    book = make_book(spark, entities=[entity("L", kind="bank"), entity("A")], loans=rows)
    assert exposure.connected_exposure(book).first().connected == 5
