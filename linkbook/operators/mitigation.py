"""Collateral mitigation and net exposure per counterparty."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.operators.exposure import PRINCIPAL, named
from linkbook.schema import SUM_MONEY

EAD = "decimal(24,4)"


def eligible_collateral(book: Book, haircut_adds: Sequence[int] = (0,)) -> DataFrame:
    """Post-haircut value of items dedicated to one counterparty.

    An item counts when every loan it secures, closed ones included, is an active
    loan of that counterparty. ``mitigant_a`` is the sum with ``a`` points added to
    every haircut (capped at 100).
    """
    loans = book.loans.select(
        F.col("loan_id").alias("securing_loan_id"),
        F.col("borrower_entity_id").alias("borrower"),
        (F.col("status") == "active").alias("live"),
    )
    items = (
        book.active_collateral.join(loans, "securing_loan_id", "left")
        .groupBy("collateral_id")
        .agg(
            F.min("borrower").alias("entity_id"),
            F.max("borrower").alias("other"),
            F.bool_and(F.coalesce("live", F.lit(False))).alias("all_live"),
            F.min_by(F.struct("collateral_value", "haircut_pct"), "securing_loan_id").alias("a"),
        )
        .filter(F.col("all_live") & (F.col("entity_id") == F.col("other")))
        .filter(F.col("a.collateral_value").isNotNull())
    )

    def kept(add: int) -> Column:
        haircut = F.least(F.coalesce("a.haircut_pct", F.lit(0)) + add, F.lit(100))
        fraction = ((100 - haircut).cast("decimal(5,0)") * F.lit(Decimal("0.01"))).cast("decimal(5,2)")
        return F.sum(F.col("a.collateral_value") * fraction).cast(EAD)

    return items.groupBy("entity_id").agg(*[kept(a).alias(f"mitigant_{a}") for a in haircut_adds])


def positions(
    book: Book, measures: dict[str, Column] | None = None, haircut_adds: Sequence[int] = (0,)
) -> DataFrame:
    """Per active borrower: gross per measure, mitigant per haircut add, longest tenor.

    One pass over loans and one over collateral, whatever the number of shocks.
    """
    measures = measures or {"base": F.col(PRINCIPAL)}
    gross = book.active_loans.groupBy(F.col("borrower_entity_id").alias("entity_id")).agg(
        *[F.sum(c).cast(SUM_MONEY).alias(f"gross_{m}") for m, c in measures.items()],
        F.max(F.coalesce("maturity_years", F.lit(3))).alias("tenor"),
    )
    joined = gross.join(eligible_collateral(book, haircut_adds), "entity_id", "left")
    return joined.select(
        "entity_id",
        "tenor",
        *[f"gross_{m}" for m in measures],
        *[
            F.coalesce(f"mitigant_{a}", F.lit(0)).cast(EAD).alias(f"mitigant_{a}")
            for a in haircut_adds
        ],
    )


def ead(gross: str | Column, mitigant: str | Column) -> Column:
    """Exposure after mitigation, never negative."""
    g = F.col(gross) if isinstance(gross, str) else gross
    m = F.col(mitigant) if isinstance(mitigant, str) else mitigant
    return F.greatest((g - m).cast(EAD), F.lit(0).cast(EAD))


def net_exposure(book: Book) -> DataFrame:
    """``entity_id, gross, mitigant, net`` for every active borrower."""
    return positions(book).select(
        "entity_id",
        F.col("gross_base").alias("gross"),
        F.col("mitigant_0").alias("mitigant"),
        ead("gross_base", "mitigant_0").alias("net"),
    )


def collateralised_names(book: Book) -> DataFrame:
    """Borrowers whose exposure collateral reduces, with name and sector."""
    sector = book.entities.select("entity_id", "sector")
    rows = net_exposure(book).filter(F.col("mitigant") > 0).join(sector, "entity_id", "left")
    return named(rows, book, "entity_id", "entity_name").select(
        "entity_id",
        "entity_name",
        F.coalesce("sector", F.lit("")).alias("sector"),
        "gross",
        "mitigant",
        "net",
    )
