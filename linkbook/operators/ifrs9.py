"""Provisioning: stages and expected credit loss."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.functions import curves
from linkbook.functions.ratings import pd_for, rating_label, stage_for
from linkbook.operators.credit import credit_base
from linkbook.operators.limits import ratio

CENTS = "decimal(24,2)"


def counterparty_ecl(book: Book, lgd: Decimal = P.LGD) -> DataFrame:
    """Stage, 12-month, lifetime and recognised loss of every active borrower.

    Products of exact parameters round half up in decimals; the discounted sum is
    a double rounded to cents.
    """
    exposure = F.col("ead").cast("double")
    lifetime = curves.lifetime_ecl(exposure, F.col("tenor"), F.col("pd").cast("double"), float(lgd))
    stage = F.col("stage")
    return (
        credit_base(book)
        .withColumn("pd", pd_for("rating"))
        .withColumn("stage", stage_for("rating"))
        .withColumn("ecl_12m", (F.col("ead") * F.col("pd") * F.lit(lgd)).cast(CENTS))
        .withColumn("ecl_lifetime", lifetime.cast("decimal(24,6)").cast(CENTS))
        .withColumn("impaired", (F.col("ead") * F.lit(lgd)).cast(CENTS))
        .select(
            "entity_id",
            rating_label("rating").alias("rating"),
            "stage",
            F.col("ead").cast(CENTS).alias("ead"),
            "ecl_12m",
            "ecl_lifetime",
            F.when(stage == 1, F.col("ecl_12m"))
            .when(stage == 3, F.col("impaired"))
            .otherwise(F.col("ecl_lifetime"))
            .alias("ecl_recognised"),
        )
        .withColumn("coverage", ratio(F.col("ecl_recognised"), F.col("ead")))
    )


def staging_summary(book: Book) -> DataFrame:
    """Count, EAD and recognised loss of stages 1..3, empty ones included."""
    spine = book.entities.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("stage"))
    totals = (
        counterparty_ecl(book)
        .groupBy("stage")
        .agg(
            F.count("*").alias("names"),
            F.sum("ead").alias("ead"),
            F.sum("ecl_recognised").alias("ecl"),
        )
    )
    return spine.join(totals, "stage", "left").select(
        "stage",
        F.coalesce("names", F.lit(0)).alias("names"),
        F.coalesce("ead", F.lit(0)).cast("decimal(34,2)").alias("ead"),
        F.coalesce("ecl", F.lit(0)).cast("decimal(34,2)").alias("ecl"),
    )


def total_ecl(book: Book) -> DataFrame:
    """One row: total recognised loss."""
    return counterparty_ecl(book).agg(
        F.coalesce(F.sum("ecl_recognised"), F.lit(0)).cast("decimal(34,2)").alias("total_ecl")
    )
