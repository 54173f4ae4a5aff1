"""Exposure profiles and valuation adjustments per counterparty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.functions import curves
from linkbook.functions.ratings import pd_for, rating_label, risk_weight_for
from linkbook.operators.credit import credit_base

CENTS = "decimal(24,2)"
LGD = float(P.LGD)


def _cents(value: Column) -> Column:
    """Cents, half up; the step over six places drops binary noise before the tie."""
    return value.cast("decimal(24,6)").cast(CENTS)


def _base(book: Book) -> tuple[DataFrame, Column, Column]:
    # The exact column keeps a name no output alias can shadow inside a lambda.
    base = credit_base(book).withColumnRenamed("ead", "net")
    return base, F.col("net").cast("double"), F.col("tenor")


def exposure_profiles(book: Book) -> DataFrame:
    """``entity_id, t, ee, pfe``: one row per counterparty and year."""
    base, ead, tenor = _base(book)
    return base.select("entity_id", F.inline(curves.profile(ead, tenor)))


def counterparty_xva(book: Book) -> DataFrame:
    """EAD, tenor, peak PFE, EPE (mean over all points) and CVA."""
    base, ead, tenor = _base(book)
    points = curves.profile(ead, tenor)
    epe = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["ee"]) / F.size(points)
    return base.select(
        "entity_id",
        rating_label("rating").alias("rating"),
        F.col("net").cast(CENTS).alias("ead"),
        tenor.alias("maturity"),
        _cents(F.array_max(F.transform(points, lambda p: p["pfe"]))).alias("peak_pfe"),
        _cents(epe).alias("epe"),
        _cents(curves.cva(ead, tenor, pd_for("rating").cast("double"), LGD)).alias("cva"),
    )


def total_cva(book: Book) -> DataFrame:
    """One row: total of the rounded CVAs."""
    return counterparty_xva(book).agg(
        F.coalesce(F.sum("cva"), F.lit(0)).cast("decimal(34,2)").alias("total_cva")
    )


def xva_breakdown(book: Book) -> DataFrame:
    """CVA, DVA, FVA, MVA, KVA and CVA - DVA + FVA + MVA + KVA, each rounded first."""
    base, ead, tenor = _base(book)
    own_pd = float(P.PD[P.OWN_RATING])
    return base.select(
        "entity_id",
        rating_label("rating").alias("rating"),
        _cents(curves.cva(ead, tenor, pd_for("rating").cast("double"), LGD)).alias("cva"),
        _cents(curves.dva(ead, tenor, own_pd, LGD)).alias("dva"),
        _cents(curves.fva(ead, tenor)).alias("fva"),
        _cents(curves.mva(ead, tenor)).alias("mva"),
        _cents(curves.kva(ead, tenor, risk_weight_for("rating").cast("double"))).alias("kva"),
    ).withColumn(
        "total_xva",
        (F.col("cva") - F.col("dva") + F.col("fva") + F.col("mva") + F.col("kva")).cast(CENTS),
    )


def xva_totals(book: Book) -> DataFrame:
    """One row: book totals of every adjustment."""
    parts = ("cva", "dva", "fva", "mva", "kva", "total_xva")
    return xva_breakdown(book).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(34,2)").alias(c) for c in parts]
    )
