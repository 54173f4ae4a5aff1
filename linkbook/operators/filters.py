"""Row filters shared by reports: value lists, parameters, anti-patterns, active records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "active")


def apply_filters(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Keep rows whose columns hold one of the wanted values.

    A list keeps those values, a ``(low, high)`` tuple a closed range (None is
    open), a bool keeps that flag; None or an empty list keeps everything.
    """
    for name, value in wanted.items():
        if name not in df.columns:
            raise KeyError(f"no column '{name}' to filter on")
        if value is None or (isinstance(value, list) and not value):
            continue
        if isinstance(value, tuple):
            low, high = value
            if low is not None:
                df = df.filter(F.col(name) >= low)
            if high is not None:
                df = df.filter(F.col(name) <= high)
        elif isinstance(value, (list, set, frozenset)):
            df = df.filter(F.col(name).isin(list(value)))
        else:
            df = df.filter(F.col(name) == value)
    return df


def bind(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Restrict ``column`` to parameters: a short list, or a DataFrame with that column."""
    if column not in df.columns:
        raise KeyError(f"no parameter '{column}'")
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def without(df: DataFrame, excluded: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows with no match in ``excluded``."""
    return df.join(excluded, on, "left_anti")


def wwr_flagged(df: DataFrame, flags: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows whose name borrows under a wrong-way-risk flag."""
    return df.join(flags.select(F.col("borrower").alias(column)).distinct(), column, "left_semi")


def amplifying(cascades: DataFrame) -> DataFrame:
    """Cascades whose contagion adds to the direct loss."""
    return cascades.filter(F.col("contagion_loss") > 0)


def second_order(runs: DataFrame) -> DataFrame:
    """Multi-round runs that default entities beyond the seed's own group."""
    return runs.filter(F.col("second_order") > 0)


def macro_hit(impacts: DataFrame) -> DataFrame:
    """Sectors a macro scenario downgrades."""
    return impacts.filter(F.col("notches") > 0)
