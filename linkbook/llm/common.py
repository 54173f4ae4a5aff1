"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkbook.plans.staging import stage

# Words end at ASCII white space; the pattern is a fixed value of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, quoted."""
    return df["`" + name.replace("`", "``") + "`"]


def with_row_ids(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once with an id for each row; the ids stay the same for every reader."""
    name = fresh(df, "row_id")
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label), name


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str], label: str) -> DataFrame:
    """Totals of all rows before each row in the order of ``order``, for the whole table.

    The table is range-sorted and written, so that the ranges stay as they are. Each range
    adds up its own rows; the totals of the ranges before it (one row per range) are joined.
    ``sums`` maps new column names to the columns to add. Rows equal in ``order`` and in the
    summed columns may change places, which changes no total.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    rows = stage(ranged, label)
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    # One row per range: bounded by the number of shuffle partitions.
    return (
        summed.join(F.broadcast(offsets), "_range")
        .withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
        .drop("_range", *[f"_{n}" for n in sums])
    )


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected groups of an undirected graph: ``a``, ``b`` -> ``node``, ``group`` (smallest node).

    Alternating star contraction: every node links its larger neighbours to its smallest one,
    then its smaller ones. Each round is written to the shared folder. The loop ends when a
    round changes nothing; a star ends after two rounds, a chain after about log2 of its length.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    edges, seen = stage(tidy(links), label), None
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(
            near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # A node has few smaller neighbours left: the heads it was linked to.
        low = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = tidy(
            low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        )
        edges = stage(small, label)
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    member = edges.groupBy("a").agg(F.min("b").alias("group")).select(F.col("a").alias("node"), "group")
    return member.union(edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())
