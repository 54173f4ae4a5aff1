"""Queries that SQL can express, on the small tables."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

from linkbook.llm import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    rows = catalog.queries()[name](spark, str(FOLDER))
    assert sorted(rows.columns) == sorted(columns)
    ours = [tuple(r) for r in rows.select(*columns).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert ours and sorted(ours, key=key) == sorted(theirs, key=key)
