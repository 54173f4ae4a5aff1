"""Joins of two large tables, which never go through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merged(df: DataFrame) -> DataFrame:
    """``df``, which is shuffled and merged when joined, whatever its size.

    Spark broadcasts what it takes for less than its threshold, through the driver and in its unpacked
    size. Where a query joins many tables just below it, all of these together outgrow the driver.
    """
    return df.hint("merge")
