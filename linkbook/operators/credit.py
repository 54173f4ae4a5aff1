"""Expected loss, risk-weighted assets and capital per counterparty and for the book."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.functions.ratings import pd_for, rating_label, risk_weight_for
from linkbook.operators.limits import eligible_capital, ratio
from linkbook.operators.mitigation import ead, positions

LOSS = "decimal(34,10)"


def expected_loss(exposure: Column, rating: str | Column, lgd: Decimal = P.LGD) -> Column:
    """PD x LGD x EAD in exact decimals."""
    return (exposure * pd_for(rating) * F.lit(lgd)).cast(LOSS)


def risk_weighted(exposure: Column, rating: str | Column) -> Column:
    return (exposure * risk_weight_for(rating)).cast("decimal(30,6)")


def capital(rwa: Column) -> Column:
    return (rwa * F.lit(P.CAPITAL_RATIO)).cast("decimal(34,8)")


def with_entity(df: DataFrame, book: Book, columns: Sequence[str]) -> DataFrame:
    return df.join(book.entities.select("entity_id", *columns), "entity_id", "left")


def credit_base(book: Book) -> DataFrame:
    """``entity_id, rating, ead, tenor``: what every per-name model starts from."""
    return with_entity(positions(book), book, ["rating"]).select(
        "entity_id",
        F.nullif("rating", F.lit("")).alias("rating"),
        "tenor",
        ead("gross_base", "mitigant_0").alias("ead"),
    )


def credit_risk(
    book: Book,
    pd_table: Mapping[str, Decimal] | None = None,
    rw_table: Mapping[str, Decimal] | None = None,
    lgd: Decimal = P.LGD,
) -> DataFrame:
    """EAD, PD, LGD, EL, RWA and capital of every active borrower."""
    rows = with_entity(positions(book), book, ["entity_name", "sector", "rating"])
    return (
        rows.withColumn("ead", ead("gross_base", "mitigant_0"))
        .withColumn("pd", pd_for("rating", pd_table))
        .withColumn("rwa", (F.col("ead") * risk_weight_for("rating", rw_table)).cast("decimal(30,6)"))
        .select(
            "entity_id",
            F.coalesce("entity_name", F.col("entity_id").cast("string")).alias("entity_name"),
            F.coalesce("sector", F.lit("")).alias("sector"),
            rating_label("rating").alias("rating"),
            "ead",
            "pd",
            F.lit(lgd).alias("lgd"),
            (F.col("ead") * F.col("pd") * F.lit(lgd)).cast(LOSS).alias("el"),
            "rwa",
            capital(F.col("rwa")).alias("capital"),
        )
    )


def portfolio_summary(book: Book) -> DataFrame:
    """One row: total EAD, EL, RWA, capital and capital over eligible capital."""
    return (
        credit_risk(book)
        .agg(
            *[
                F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(f"total_{c}")
                for c, t in (
                    ("ead", "decimal(34,4)"),
                    ("el", "decimal(38,10)"),
                    ("rwa", "decimal(38,6)"),
                    ("capital", "decimal(38,8)"),
                )
            ]
        )
        .withColumn("capital_pct_eligible", ratio(F.col("total_capital"), eligible_capital(book)))
    )
