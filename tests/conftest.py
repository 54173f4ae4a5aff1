import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from books import calm_rows, make_book, stressed_rows  # noqa: E402

from linkbook.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def stressed(spark):
    return make_book(spark, **stressed_rows())


@pytest.fixture(scope="session")
def calm(spark):
    return make_book(spark, **calm_rows())
