"""A corpus pipeline of five operators over ``documents``.

Each stage takes the rows that the one before kept and returns the columns of ``documents``; the
last one, the mix, adds the words taken of each document. A stage's result is written before the
next one begins, which then deletes the scratch tables of the one before, unless it reads them.

Null and empty texts, repeated rows, ties and further columns are treated as the operators that
the stages call say; rows are kept or dropped whole, also where ids repeat or are null. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from linkbook.llm.decontamination import without_contaminated
from linkbook.llm.jaccard_join import one_per_class
from linkbook.llm.line_dedup import without_duplicate_lines
from linkbook.llm.mixing import mixed_documents
from linkbook.llm.toxicity import without_toxic
from linkbook.plans.staging import release, stage, watched

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: dict[str, list[str]] = {}


def _own_scratch(function: Stage) -> Stage:
    """``function``, before which the scratch tables of the stage before are deleted."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        kept = release(_scratch.get(app, []), docs)
        with watched() as made:
            out = function(spark, docs, sf_dir)
        _scratch[app] = kept + made
        return out

    return run_stage


@_own_scratch
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled rows of ``docs``, accepts."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_own_scratch
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those left without words go."""
    return without_duplicate_lines(docs)


@_own_scratch
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_per_class(docs)


@_own_scratch
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_own_scratch
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document taken, with its number of words taken."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]
# Training a classifier and grouping near copies are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
