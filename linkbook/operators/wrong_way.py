"""Wrong-way risk: collateral issued by, or correlated with, the borrower."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.operators.exposure import named


def _issued(book: Book, loan_ids: DataFrame | None = None) -> DataFrame:
    """Active loans with active issued collateral and both ultimate parents; of ``loan_ids`` only, if given."""
    own = book.ownership.select("entity_id", "ubo")
    issuer = own.select(F.col("entity_id").alias("issuer"), F.col("ubo").alias("issuer_ubo"))
    borrower = own.select(F.col("entity_id").alias("borrower"), F.col("ubo").alias("borrower_ubo"))
    loans = book.active_loans.select("loan_id", F.col("borrower_entity_id").alias("borrower"))
    if loan_ids is not None:
        loans = loans.join(loan_ids, "loan_id", "left_semi")
    return (
        book.active_collateral.filter(F.col("issuer_entity_id").isNotNull())
        .select(
            F.col("securing_loan_id").alias("loan_id"),
            F.col("collateral_id").alias("collateral"),
            F.col("issuer_entity_id").alias("issuer"),
        )
        .distinct()
        .join(loans, "loan_id")
        .join(issuer, "issuer", "left")
        .join(borrower, "borrower", "left")
        .withColumn("issuer_ubo", F.coalesce("issuer_ubo", "issuer"))
        .withColumn("borrower_ubo", F.coalesce("borrower_ubo", "borrower"))
    )


def structural_wwr(book: Book, loan_ids: DataFrame | None = None) -> DataFrame:
    """Loans whose collateral issuer has the borrower's ultimate parent; of ``loan_ids`` only, if given."""
    rows = (
        _issued(book, loan_ids)
        .filter(F.col("issuer_ubo") == F.col("borrower_ubo"))
        .select("loan_id", "borrower", "collateral", "issuer", F.col("borrower_ubo").alias("group"))
    )
    return named(named(rows, book, "borrower", "borrower_name"), book, "issuer", "issuer_name")


def general_wwr(book: Book) -> DataFrame:
    """Other-group issuers in the borrower's sector, else in its country."""

    def traits(role: str) -> DataFrame:
        return book.entities.select(
            F.col("entity_id").alias(role),
            F.col("sector").alias(f"{role}_sector"),
            F.nullif("country", F.lit("")).alias(f"{role}_country"),
        )

    return (
        _issued(book)
        .filter(F.col("issuer_ubo") != F.col("borrower_ubo"))
        .join(traits("borrower"), "borrower")
        .join(traits("issuer"), "issuer")
        .withColumn(
            "driver",
            F.when(F.col("borrower_sector") == F.col("issuer_sector"), "sector").when(
                F.col("borrower_country") == F.col("issuer_country"), "country"
            ),
        )
        .filter(F.col("driver").isNotNull())
        .select("loan_id", "borrower", "collateral", "issuer", "driver")
    )
