"""Parquet store of named datasets: ``{root}/dataset={name}/version={n}/{table}``.

A save first claims a number by a file that must not exist yet, writes the version whole, and then
publishes it by its marker, one small file. Readers take the newest published version, so a dataset
can be read, changed and saved to its own name, and a save that fails leaves the version before as it
was. Of saves that overlap, the one that ends last is the newest: if a later number was published
meanwhile, the version moves to the next free one.
"""

from __future__ import annotations

import os
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.schema import TABLES

DEFAULT_DATASET = "calm"
DATASET_VARIABLE = "LINKBOOK_DATASET"
PUBLISHED = "_PUBLISHED"
CLAIMED = "_CLAIMED"


def dataset_name(flag: str | None = None) -> str:
    """Chosen dataset: the flag, else the environment, else calm."""
    return flag or os.environ.get(DATASET_VARIABLE, DEFAULT_DATASET)


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> dict[int, bool]:
    """Version -> whether it is published."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(path)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    marker = lambda n: _files(spark, f"{folder}/version={n}/{PUBLISHED}")[0]
    return {n: files.exists(marker(n)) for n in numbers}


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if another save was first."""
    target, files = _files(spark, path)
    try:
        files.create(target, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def claim(spark: SparkSession, folder: str) -> int:
    """A version number that no other save has or gets."""
    number = max(_versions(spark, folder), default=0) + 1
    while not _create(spark, f"{folder}/version={number}/{CLAIMED}"):
        number += 1
    return number


def publish(spark: SparkSession, folder: str, number: int) -> int:
    """Make a written version the newest; its number, a new one if a later version was published first."""
    while max((n for n, done in _versions(spark, folder).items() if done), default=0) > number:
        moved = claim(spark, folder)
        for table in TABLES:
            source, files = _files(spark, f"{folder}/version={number}/{table}")
            if not files.rename(source, _files(spark, f"{folder}/version={moved}/{table}")[0]):
                raise OSError(f"cannot move {source}")
        files.delete(_files(spark, f"{folder}/version={number}")[0], True)
        number = moved
    _create(spark, f"{folder}/version={number}/{PUBLISHED}")
    return number


def save(book: Book, root: str, dataset: str) -> None:
    """Replace one dataset, other datasets untouched; repeating it gives the same content.

    The version before stays for those who are reading it; older published ones are deleted.
    """
    spark = book.loans.sparkSession
    folder = f"{root}/dataset={dataset}"
    published = [n for n, done in _versions(spark, folder).items() if done]
    new = claim(spark, folder)
    for table, df in book.tables().items():
        df.write.parquet(f"{folder}/version={new}/{table}")
    publish(spark, folder, new)
    for n in sorted(published)[:-1]:
        path, files = _files(spark, f"{folder}/version={n}")
        files.delete(path, True)


def load(spark: SparkSession, root: str, dataset: str | None = None) -> Book:
    """The newest published version of one dataset; only its folder is listed and read."""
    name = dataset_name(dataset)
    folder = f"{root}/dataset={name}"
    published = [n for n, done in _versions(spark, folder).items() if done]
    if not published:
        raise FileNotFoundError(f"no published version of dataset {name} in {root}")
    return Book(**{t: spark.read.parquet(f"{folder}/version={max(published)}/{t}") for t in TABLES})


def load_counts(book: Book) -> DataFrame:
    """``table, rows``."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "rows")
        for table, df in book.tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)
