"""Every registered query against its SQL statement on the small order tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from linkbook.catalog import oracle
from linkbook.catalog import queries as catalog

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, STATEMENTS = catalog.queries(), oracle.oracle_sql()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the order tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, Decimal):
        return float(value)
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    ours = [tuple(_norm(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(STATEMENTS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(_norm(r[i]) for i in order) for r in cursor.fetchall()]
    assert ours and _sorted(ours) == _sorted(theirs)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry_points.queries()) and set(STATEMENTS) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["entity_id", "entity_name"] and df.count() == 53
