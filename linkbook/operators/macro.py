"""Macro scenarios: factor intensities times sector sensitivities give rating notches."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.operators.scenarios import (
    BASE,
    Shock,
    apply_shock,
    shocked_positions,
    summary_by_scenario,
)

Intensities = Mapping[str, Mapping[str, float]]


def sector_notches(
    intensity: Mapping[str, float],
    sensitivity: Mapping[str, Mapping[str, float]] | None = None,
) -> dict[str, int]:
    """Notches per sector: the summed product, rounded half to even, at most four."""
    out = {}
    for sector, weights in (sensitivity or P.SECTOR_SENSITIVITY).items():
        raw = sum(
            (Decimal(str(intensity.get(f, 0))) * Decimal(str(w)) for f, w in weights.items()),
            Decimal(0),
        )
        out[sector] = min(P.MACRO_MAX_NOTCHES, round(raw))
    return out


def macro_shocks(scenarios: Intensities | None = None) -> list[Shock]:
    return [
        Shock(key, P.MACRO_LABEL.get(key, key), sector_notches=sector_notches(intensity))
        for key, intensity in (scenarios or P.MACRO_INTENSITY).items()
    ]


def apply_macro(book: Book, key: str) -> Book:
    """A new book with every entity downgraded by its sector's notches."""
    return apply_shock(book, {s.key: s for s in macro_shocks()}[key])


def notches_by_sector(book: Book, scenarios: Intensities | None = None) -> DataFrame:
    """``scenario, sector, notches, names`` over all entities of the book."""
    sectors = book.entities.groupBy("sector").agg(F.count("*").alias("names"))
    rows = [
        F.struct(F.lit(s.key).alias("scenario"), s.steps().cast("int").alias("notches"))
        for s in macro_shocks(scenarios)
    ]
    return sectors.select("sector", "names", F.inline(F.array(*rows))).select(
        "scenario", "sector", "notches", "names"
    )


def macro_compare(book: Book, scenarios: Intensities | None = None) -> DataFrame:
    """EL, capital and downgrade counts per macro scenario, base included.

    Downgrades are counted over all entities, the lender too.
    """
    shocks = [BASE, *macro_shocks(scenarios)]
    counts = (
        notches_by_sector(book, scenarios)
        .groupBy("scenario")
        .agg(
            F.sum(F.when(F.col("notches") > 0, F.col("names")).otherwise(0)).alias(
                "names_downgraded"
            ),
            F.sum(F.col("notches") * F.col("names")).alias("total_notches"),
        )
    )
    return (
        summary_by_scenario(book, shocks)
        .join(counts, "scenario", "left")
        .select(
            "scenario",
            "total_el",
            "total_capital",
            "capital_pct_eligible",
            F.coalesce("names_downgraded", F.lit(0)).alias("names_downgraded"),
            F.coalesce("total_notches", F.lit(0)).alias("total_notches"),
        )
    )


def sector_impacts(book: Book, scenarios: Intensities | None = None) -> DataFrame:
    """Notches and expected loss, base and shocked, per borrower sector and scenario."""
    shocks = macro_shocks(scenarios)
    notches = notches_by_sector(book, scenarios).select("scenario", "sector", "notches")
    return (
        shocked_positions(book, shocks)
        .groupBy("scenario", "sector")
        .agg(
            F.sum("el_base").cast("decimal(38,10)").alias("el_base"),
            F.sum("el").cast("decimal(38,10)").alias("el_shocked"),
        )
        .join(notches, ["scenario", "sector"], "left")
        .select(
            "scenario",
            "sector",
            "notches",
            "el_base",
            "el_shocked",
            (F.col("el_shocked") - F.col("el_base")).cast("decimal(38,10)").alias("el_delta"),
        )
    )
