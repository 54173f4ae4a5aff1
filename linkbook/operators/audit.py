"""Verification of a hash-chained audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook.plans.staging import stage
from linkbook.sources.audit_log import parse

# Fixed value: the previous hash of the first record.
GENESIS = "0" * 64


def body_text(line: Column) -> Column:
    """The hashed body: the line without its ``entry_hash`` pair.

    Lines hold their keys in sorted order, so the pair follows ``correlation_id``
    and dropping it leaves the exact text that was hashed.
    """
    return F.regexp_replace(line, r'^(.*?)"entry_hash": (?:"[^"]*"|null), ', "$1")


def chain_problems(lines: DataFrame) -> DataFrame:
    """``seq, problem``: altered content, broken links, duplicate and missing numbers.

    Links are a self-join on ``seq = seq + 1``; nothing is ordered globally. Lines are
    parsed and hashed once, into a narrow staged table.
    """
    digest = F.sha2(body_text(F.col("value")), 256)
    rows = stage(
        parse(lines).select(
            "seq",
            "prev_hash",
            "entry_hash",
            (~digest.eqNullSafe(F.col("entry_hash"))).alias("altered"),
        ),
        "audit",
    )
    altered = rows.filter("altered").select(
        "seq", F.lit("entry_hash mismatch (content altered)").alias("problem")
    )
    counts = rows.groupBy("seq").agg(F.count("*").alias("n"))
    repeated = counts.filter("n > 1").select("seq", F.lit("seq out of order").alias("problem"))
    expected = rows.select(
        (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("expected")
    )
    # A number is missing where a record's predecessor is; runs of gaps show once.
    linked = rows.join(expected, "seq", "left")
    gaps = linked.filter((F.col("seq") > 0) & F.col("expected").isNull()).select(
        "seq", F.lit("seq out of order").alias("problem")
    )
    first = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("expected"))
    broken = linked.filter(~F.col("prev_hash").eqNullSafe(first)).select(
        "seq", F.lit("prev_hash does not chain").alias("problem")
    )
    unnumbered = rows.filter(F.col("seq").isNull() | (F.col("seq") < 0)).select(
        "seq", F.lit("seq out of order").alias("problem")
    )
    return (
        altered.unionByName(repeated)
        .unionByName(gaps)
        .unionByName(broken)
        .unionByName(unnumbered)
        .distinct()
    )


def ordered_chain_problems(lines: DataFrame) -> DataFrame:
    """``at, seq, problem`` of numbered lines (``at, value``): the log as it lies in its files.

    A record's number is its place, and it links to the line before it, so lines that changed
    places are told even if all are there. Neighbours meet by their places, which are unique.
    """
    digest = F.sha2(body_text(F.col("value")), 256)
    rows = stage(
        parse(lines).select("at", "seq", "prev_hash", "entry_hash", (~digest.eqNullSafe(F.col("entry_hash"))).alias("altered")), "audit"
    )
    before = rows.select((F.col("at") + 1).alias("at"), F.col("entry_hash").alias("expected"))
    linked = rows.join(before, "at", "left")
    expected = F.when(F.col("at") == 0, F.lit(GENESIS)).otherwise(F.col("expected"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("altered"), "entry_hash mismatch (content altered)"),
            F.when(~F.col("seq").eqNullSafe(F.col("at")), "seq out of order"),
            F.when(~F.col("prev_hash").eqNullSafe(expected), "prev_hash does not chain"),
        )
    )
    return linked.select("at", "seq", F.explode(problems).alias("problem"))


def chain_status(lines: DataFrame) -> DataFrame:
    """One row: ``ok, length, problems`` (their number)."""
    length = lines.agg(F.count("*").alias("length")).scalar()
    return chain_problems(lines).agg(
        (F.count("*") == 0).alias("ok"), F.count("*").alias("problems")
    ).withColumn("length", length)
