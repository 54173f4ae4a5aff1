"""Cut lineage by writing a table to the cluster's shared checkpoint folder.

Iterative operators (ownership walk, default cascade) write each round as
Parquet. A lost executor re-reads the table instead of replaying the loop, and
later reads still prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_watching: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/linkbook-{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for made in _watching:
        made.append(path)
    return path


@contextmanager
def watched() -> Iterator[list[str]]:
    """The scratch paths that are taken inside the block."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def release(paths: list[str], docs: DataFrame) -> list[str]:
    """Delete the scratch tables of a step whose result has been written; those that ``docs`` reads stay and are returned."""
    spark, read = docs.sparkSession, docs.inputFiles() if paths else []
    kept = [p for p in paths if any(p.rpartition("/")[2] in file for file in read)]
    for path in set(paths) - set(kept):
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return kept


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared folder and return a DataFrame reading it back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """:func:`stage` of tables that do not depend on each other, side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(stage, tables.values(), tables))


class Growing:
    """A table in the shared folder that rounds of a loop append to."""

    def __init__(self, spark: SparkSession, label: str, first: DataFrame) -> None:
        self._spark, self._schema, self._path, self._n = spark, first.schema, scratch(spark, label), 0
        self.append(first)

    def append(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and return them, read back."""
        part = f"{self._path}/{self._n}"
        rows.write.parquet(part)
        self._n += 1
        return self._spark.read.schema(self._schema).parquet(part)

    def rows(self) -> DataFrame:
        """All rows so far."""
        return self._spark.read.schema(self._schema).option("recursiveFileLookup", "true").parquet(self._path)
