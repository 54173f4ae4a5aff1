"""Audit log: JSON lines, read as text so the hashed bytes survive, and parsed on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkbook.plans.staging import stage

RECORD = (
    "action string, target string, actor string, role string, outcome string, reason string, "
    "payload string, flags array<string>, timestamp string, correlation_id string, "
    "seq bigint, prev_hash string, entry_hash string"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: non-blank lines as written."""
    return spark.read.text(path).filter(F.trim("value") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, value``: non-blank lines with their place in the log, files in the order of their names.

    Splits number their own lines as they read them; what stands before a split is added up from
    one row a split. Lines are written once, so the numbers hold for every reader.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = stage(read_lines(spark, path).select(*split, F.monotonically_increasing_id().alias("id"), "value"), "log-lines")
    counts = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "block"]).select((F.col("start") + F.col("id") - F.col("first")).alias("at"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """Typed records; ``payload`` stays JSON text because its keys vary by action."""
    others = [c for c in lines.columns if c != "value"]
    return lines.select("value", *others, F.from_json("value", RECORD).alias("r")).select("value", *others, "r.*")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Typed audit records of a log file or folder."""
    return parse(read_lines(spark, path)).drop("value")
