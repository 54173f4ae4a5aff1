"""Concentration of direct and attributed exposure: HHI, top-k ratio, shares, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.operators.exposure import PRINCIPAL, attributed_vector, direct_vector
from linkbook.plans.staging import stage
from linkbook.schema import SUM_MONEY


def _vectors(book: Book) -> DataFrame:
    """Both exposure vectors, ``kind, name, exposure``: computed once per book and re-read."""
    if "_vectors" not in book.__dict__:
        direct = direct_vector(book).select(
            F.lit("direct").alias("kind"), "name", F.col(PRINCIPAL).alias("exposure")
        )
        connected = attributed_vector(book).select(
            F.lit("connected").alias("kind"), F.col("owner").alias("name"), "exposure"
        )
        book.__dict__["_vectors"] = stage(direct.unionByName(connected), "vectors")
    return book.__dict__["_vectors"]


def _owners(book: Book) -> DataFrame:
    """The attributed vector, ``owner, exposure``."""
    return (
        _vectors(book)
        .filter(F.col("kind") == "connected")
        .select(F.col("name").alias("owner"), "exposure")
    )


def hhi(vector: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Herfindahl-Hirschman index of ``exposure``, per ``by``; 0 for an empty vector."""
    e = F.col("exposure").cast("double")
    squares = F.sum(e * e)
    total = F.sum("exposure").cast("double")
    return vector.groupBy(*by).agg(
        F.coalesce(F.try_divide(squares, total * total), F.lit(0.0)).alias("hhi")
    )


def top_k(vector: DataFrame, k: int = P.TOP_K, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` largest rows per ``by``, ties by name.

    The rank filter is limited inside every input partition before the shuffle,
    so at most ``k`` rows per partition and group move.
    """
    if not by:
        return vector.orderBy(F.desc("exposure"), F.asc("name")).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("exposure"), F.asc("name"))
    return (
        vector.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    )


def top_k_ratio(vector: DataFrame, k: int = P.TOP_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the ``k`` largest exposures in the total; 0 for an empty vector."""
    part = top_k(vector, k, by).select(*by, F.lit(True).alias("top"), "exposure")
    whole = vector.select(*by, F.lit(False).alias("top"), "exposure")
    return (
        part.unionByName(whole)
        .groupBy(*by)
        .agg(
            F.coalesce(
                F.try_divide(
                    F.sum(F.when(F.col("top"), F.col("exposure"))).cast("double"),
                    F.sum(F.when(~F.col("top"), F.col("exposure"))).cast("double"),
                ),
                F.lit(0.0),
            ).alias("ratio")
        )
    )


def _side_by_side(rows: DataFrame, value: str, suffix: str) -> DataFrame:
    return rows.agg(
        *[
            F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(value))), F.lit(0.0)).alias(
                f"{kind}_{suffix}"
            )
            for kind in ("direct", "connected")
        ]
    )


def hhi_direct_connected(book: Book) -> DataFrame:
    """One row: ``direct_hhi, connected_hhi``."""
    return _side_by_side(hhi(_vectors(book), ("kind",)), "hhi", "hhi")


def cr_direct_connected(book: Book, k: int = P.TOP_K) -> DataFrame:
    """One row: ``direct_cr, connected_cr`` for the top ``k``."""
    return _side_by_side(top_k_ratio(_vectors(book), k, ("kind",)), "ratio", "cr")


def dimension_shares(book: Book, attribute: str, default: str) -> DataFrame:
    """``bucket, exposure, share`` of attributed exposure by an attribute of the owner.

    Attribution keeps the book's total, so the denominator is one sum over loans.
    """
    attributes = book.entities.select(F.col("entity_id").alias("owner"), attribute)
    total = book.active_loans.agg(F.sum(PRINCIPAL).cast("double").alias("total")).scalar()
    return (
        _owners(book)
        .join(attributes, "owner", "left")
        .withColumn("bucket", F.coalesce(F.nullif(attribute, F.lit("")), F.lit(default)))
        .groupBy("bucket")
        .agg(F.sum("exposure").cast(SUM_MONEY).alias("exposure"))
        .withColumn("share", F.try_divide(F.col("exposure").cast("double"), total))
    )


def sector_shares(book: Book) -> DataFrame:
    return dimension_shares(book, "sector", "")


def country_shares(book: Book) -> DataFrame:
    return dimension_shares(book, "country", "unknown")


def rating_shares(book: Book) -> DataFrame:
    return dimension_shares(book, "rating", "unrated")


def sub_investment_grade_share(book: Book) -> DataFrame:
    """One row: share held by BB, B and CCC owners."""
    return rating_shares(book).agg(
        F.coalesce(
            F.sum(F.when(F.col("bucket").isin(*P.SUB_INVESTMENT_GRADE), F.col("share"))),
            F.lit(0.0),
        ).alias("sub_investment_grade_share")
    )


def top_bucket(shares: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest bucket (ties to the smaller key), or ``-`` for an empty vector."""
    return shares.groupBy(*by).agg(
        F.coalesce(F.min_by("bucket", F.struct(-F.col("exposure"), "bucket")), F.lit("-")).alias(
            "bucket"
        ),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("share"),
    )


def government_share(book: Book) -> DataFrame:
    """One row: attributed exposure to government owners and its share."""
    rows = dimension_shares(book, "counterparty_type", "").filter(F.col("bucket") == "government")
    return rows.agg(
        F.coalesce(F.sum("exposure"), F.lit(0)).cast(SUM_MONEY).alias("exposure"),
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"),
    )


def cr_band(ratio: Column) -> Column:
    return (
        F.when(ratio > P.CR_HIGH_ABOVE, "high")
        .when(ratio >= P.CR_ELEVATED_FROM, "elevated")
        .when(ratio >= P.CR_NORMAL_FROM, "normal")
        .otherwise("low")
    )


def threshold_flags(book: Book) -> DataFrame:
    """Metric, key, value and whether it is above its threshold."""
    indices = hhi_direct_connected(book).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{kind} HHI").alias("metric"),
                        F.lit("book").alias("key"),
                        F.col(f"{kind}_hhi").alias("value"),
                        F.when(F.col(f"{kind}_hhi") > P.HHI_HIGH, "high")
                        .otherwise("normal")
                        .alias("level"),
                    )
                    for kind in ("direct", "connected")
                ]
            )
        )
    )
    ratios = cr_direct_connected(book).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{kind} CR10").alias("metric"),
                        F.lit("book").alias("key"),
                        F.col(f"{kind}_cr").alias("value"),
                        cr_band(F.col(f"{kind}_cr")).alias("level"),
                    )
                    for kind in ("direct", "connected")
                ]
            )
        )
    )
    sectors = sector_shares(book).select(
        F.lit("sector share").alias("metric"),
        F.col("bucket").alias("key"),
        F.col("share").alias("value"),
        F.when(F.col("share") > P.SECTOR_HIGH, "high").otherwise("normal").alias("level"),
    )
    return (
        indices.unionByName(ratios)
        .unionByName(sectors)
        .withColumn("flagged", F.col("level") == "high")
    )
