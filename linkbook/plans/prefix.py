"""Running totals over a whole table, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkbook.plans.staging import stage


def totals_before(df: DataFrame, order: Sequence[str], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with the totals of all rows before each row, in the order of ``order`` (null last).

    ``sums`` maps new columns to columns of ``df``; ``order`` has to be unique. Rows are
    range-sorted and written; a range adds up its own rows and takes what the ranges before it
    hold, one row a range, from a broadcast table.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = stage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    starts = held.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(starts), "_range")
        .withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()})
        .drop("_range", *[f"_{n}" for n in sums])
    )
