"""Named shocks, run together: one pass over the book for any number of scenarios.

Loans and collateral are aggregated once, with a wide column per distinct
exposure factor and haircut add. Scenarios fan out only over the per-borrower
rows and feed straight into partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.functions.ratings import notch_down, rating_label
from linkbook.operators.concentration import top_bucket
from linkbook.operators.credit import capital, expected_loss, risk_weighted
from linkbook.operators.exposure import (
    PRINCIPAL,
    attributed_parts,
    connected_parts,
    connected_total,
)
from linkbook.operators.limits import eligible_capital, exact_band, ratio
from linkbook.operators.mitigation import ead, positions
from linkbook.plans.joins import merged
from linkbook.plans.staging import stage
from linkbook.schema import SUM_MONEY

ONE = Decimal(1)


@dataclass(frozen=True)
class Shock:
    """A scenario: who is hit, and what happens to ratings, exposure and haircuts."""

    key: str
    label: str = ""
    notches: int = 0
    column: str | None = None  # entity column that selects who is hit; None hits all
    value: str | None = None
    exposure_factor: Decimal = ONE
    haircut_add: int = 0
    sector_notches: Mapping[str, int] | None = None

    def hits(self, prefix: str = "") -> Column:
        if self.column is None:
            return F.lit(True)
        return F.coalesce(F.col(prefix + self.column) == self.value, F.lit(False))

    def steps(self) -> Column:
        """Notches of an entity row."""
        if self.sector_notches:
            pairs = [x for k, n in self.sector_notches.items() for x in (F.lit(k), F.lit(n))]
            return F.coalesce(
                F.try_element_at(F.create_map(*pairs), F.coalesce("sector", F.lit(""))), F.lit(0)
            )
        return F.when(self.hits(), F.lit(self.notches)).otherwise(0)

    def rating(self) -> Column:
        """Shocked rating of an entity row."""
        if not self.notches and not self.sector_notches:
            return F.col("rating")
        return notch_down("rating", self.steps())


# Scenario keys, labels and shock sizes.
BASE = Shock("base", "Base (no shock)")
SCENARIOS = (
    BASE,
    Shock("nbfi_downgrade", "NBFI downgrade (−2 notches)", 2, "counterparty_type", "nbfi"),
    Shock("broad_downgrade", "Broad downgrade (−1 notch)", 1),
    Shock("haircut_plus20", "Collateral haircuts +20pp", haircut_add=20),
    Shock(
        "cre_downturn",
        "CRE downturn (−1 notch, +25% draw)",
        1,
        "sector",
        "commercial real estate",
        Decimal("1.25"),
    ),
)

ENTITY_TRAITS = ("rating", "sector", "counterparty_type")


def scaled(factor: Decimal, column: str = PRINCIPAL) -> Column:
    """Principal times ``factor``, cut to whole currency units; untouched at factor 1."""
    if factor == ONE:
        return F.col(column)
    return F.floor(F.col(column) * F.lit(factor)).cast("decimal(20,2)")


def _factor_name(factor: Decimal) -> str:
    return "x" + str(factor.normalize()).replace(".", "_")


def notched_entities(book: Book, shock: Shock) -> DataFrame:
    """Entities with shocked ratings."""
    return book.entities.withColumn("rating", shock.rating())


def apply_shock(book: Book, shock: Shock) -> Book:
    """A new book with the shock applied; the input book is unchanged."""
    loans = book.loans
    if shock.exposure_factor != ONE:
        loans = _measured_loans(book, [shock]).withColumn(
            PRINCIPAL, F.col(_measure(shock))
        ).drop(_measure(shock))
    collateral = book.collateral
    if shock.haircut_add:
        raised = F.least(F.coalesce("haircut_pct", F.lit(0)) + shock.haircut_add, F.lit(100))
        collateral = collateral.withColumn("haircut_pct", raised.cast("int"))
    new = book.with_tables(
        entities=notched_entities(book, shock), loans=loans, collateral=collateral
    )
    assert book.ownership is not None  # walked once, for all scenarios
    new.share_ownership(book)  # ratings move, owners do not
    return new


# --- credit risk by scenario -----------------------------------------------


def shocked_positions(book: Book, shocks: Sequence[Shock]) -> DataFrame:
    """One row per active borrower and scenario.

    ``scenario, entity_id, sector, rating_base, rating, ead, el, rwa`` and the
    unshocked ``el_base``.
    """
    factors = sorted({ONE, *(s.exposure_factor for s in shocks)})
    adds = sorted({0, *(s.haircut_add for s in shocks)})
    rows = positions(book, {_factor_name(f): scaled(f) for f in factors}, adds).join(
        merged(book.entities.select("entity_id", *ENTITY_TRAITS)), "entity_id", "left"
    )
    base_gross = f"gross_{_factor_name(ONE)}"

    def shocked(s: Shock) -> Column:
        gross = F.when(s.hits(), F.col(f"gross_{_factor_name(s.exposure_factor)}")).otherwise(
            F.col(base_gross)
        )
        exposure = ead(gross, F.col(f"mitigant_{s.haircut_add}"))
        return F.struct(
            F.lit(s.key).alias("scenario"), s.rating().alias("rating"), exposure.alias("ead")
        )

    fanned = rows.select(
        "entity_id",
        "sector",
        F.col("rating").alias("rating_base"),
        ead(base_gross, "mitigant_0").alias("ead_base"),
        F.inline(F.array(*[shocked(s) for s in shocks])),
    )
    return fanned.select(
        "scenario",
        "entity_id",
        "sector",
        "rating_base",
        "rating",
        "ead",
        expected_loss(F.col("ead"), "rating").alias("el"),
        risk_weighted(F.col("ead"), "rating").alias("rwa"),
        expected_loss(F.col("ead_base"), "rating_base").alias("el_base"),
    )


def summary_by_scenario(book: Book, shocks: Sequence[Shock]) -> DataFrame:
    """Portfolio totals per scenario."""
    return (
        shocked_positions(book, shocks)
        .groupBy("scenario")
        .agg(
            F.sum("ead").cast("decimal(34,4)").alias("total_ead"),
            F.sum("el").cast("decimal(38,10)").alias("total_el"),
            F.sum("rwa").cast("decimal(30,6)").alias("total_rwa"),
        )
        .withColumn("total_capital", capital(F.col("total_rwa")))
        .withColumn("capital_pct_eligible", ratio(F.col("total_capital"), eligible_capital(book)))
    )


# --- exposure by scenario ---------------------------------------------------


def _measure(shock: Shock) -> str:
    if shock.exposure_factor == ONE:
        return PRINCIPAL
    who = "all" if shock.column is None else f"{shock.column}_{shock.value}".replace(" ", "_")
    return f"{_factor_name(shock.exposure_factor)}_{who}"


def _measured_loans(book: Book, shocks: Sequence[Shock]) -> DataFrame:
    """Loans with one extra amount column per distinct exposure shock."""
    loans = book.loans
    moving = {_measure(s): s for s in shocks if s.exposure_factor != ONE}
    selectors = sorted({s.column for s in moving.values() if s.column})
    if selectors:
        traits = book.entities.select(
            F.col("entity_id").alias("borrower_entity_id"),
            *[F.col(c).alias(f"borrower_{c}") for c in selectors],
        )
        loans = loans.join(merged(traits), "borrower_entity_id", "left")
    amounts = [
        F.when(s.hits("borrower_"), scaled(s.exposure_factor)).otherwise(F.col(PRINCIPAL)).alias(m)
        for m, s in moving.items()
    ]
    return loans.select(*book.loans.columns, *amounts)


def measured_book(book: Book, shocks: Sequence[Shock]) -> tuple[Book, list[str]]:
    """The book with an amount column per exposure shock, and the column names in use."""
    measures = list(dict.fromkeys([PRINCIPAL, *(_measure(s) for s in shocks)]))
    if measures == [PRINCIPAL]:
        return book, measures
    return book.with_tables(loans=_measured_loans(book, shocks)), measures


def rating_shares_by_scenario(book: Book, shocks: Sequence[Shock]) -> DataFrame:
    """``scenario, bucket, exposure, share`` of attributed exposure by shocked owner rating."""
    measured, measures = measured_book(book, shocks)
    traits = book.entities.select(F.col("entity_id").alias("owner"), *ENTITY_TRAITS)
    owners = attributed_parts(measured, measures).join(merged(traits), "owner", "left")
    rows = (
        owners.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(s.key).alias("scenario"),
                            rating_label(s.rating()).alias("bucket"),
                            F.col(_measure(s)).alias("exposure"),
                        )
                        for s in shocks
                    ]
                )
            )
        )
        .groupBy("scenario", "bucket")
        .agg(F.sum("exposure").cast(SUM_MONEY).alias("exposure"))
    )
    # One row per scenario and grade is left, so the window partitions are tiny.
    total = F.sum("exposure").over(Window.partitionBy("scenario"))
    return rows.withColumn("total", total).select(
        "scenario", "bucket", "exposure", ratio(F.col("exposure"), F.col("total")).alias("share")
    )


def bands_by_scenario(book: Book, shocks: Sequence[Shock]) -> DataFrame:
    """``scenario, red, amber, green``: watchlist band counts."""
    measured, measures = measured_book(book, shocks)
    connected = connected_parts(measured, measures).select(
        F.col("head").alias("entity_id"),
        *[connected_total(m).alias(m) for m in measures],
    )
    limits = book.active_limits.select("entity_id", "single_name_limit")
    rows = limits.join(merged(connected), "entity_id", "left").select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s.key).alias("scenario"),
                        exact_band(
                            F.coalesce(F.col(_measure(s)), F.lit(0)), F.col("single_name_limit")
                        ).alias("band"),
                    )
                    for s in shocks
                ]
            )
        )
    )
    return rows.groupBy("scenario").agg(
        *[F.count_if(F.col("band") == b).alias(b) for b in ("red", "amber", "green")]
    )


# --- reports ----------------------------------------------------------------


def snapshots(book: Book, shocks: Sequence[Shock] = SCENARIOS) -> DataFrame:
    """Headline metrics of every scenario, one row each."""
    top = top_bucket(rating_shares_by_scenario(book, shocks), ("scenario",)).select(
        "scenario", F.col("bucket").alias("top_rating"), F.col("share").alias("top_rating_share")
    )
    bands = bands_by_scenario(book, shocks).select(
        "scenario", F.col("red").alias("watchlist_red"), F.col("amber").alias("watchlist_amber")
    )
    return (
        summary_by_scenario(book, shocks)
        .join(top, "scenario", "left")
        .join(bands, "scenario", "left")
    )


def against_base(
    rows: DataFrame, columns: Sequence[str], keys: Sequence[str], base_key: str = "base"
) -> DataFrame:
    """Each scenario of ``keys`` next to the base: ``c`` and ``c_base`` for the given columns.

    The base row is repeated under every key, so the join is on the scenario. The
    rows (one per scenario) are staged, as both sides read them.
    """
    rows = stage(rows, "scenarios")
    others = F.array(*[F.lit(k) for k in keys if k != base_key])
    base = rows.filter(F.col("scenario") == base_key).select(
        F.explode(others).alias("scenario"), *[F.col(c).alias(f"{c}_base") for c in columns]
    )
    return rows.join(base, "scenario")


def compare(book: Book, shocks: Sequence[Shock] = SCENARIOS) -> DataFrame:
    """Shocked snapshots with the base alongside."""
    columns = (
        "total_ead",
        "total_el",
        "total_capital",
        "capital_pct_eligible",
        "top_rating",
        "top_rating_share",
        "watchlist_red",
        "watchlist_amber",
    )
    return against_base(snapshots(book, shocks), columns, [s.key for s in shocks])


def expected_loss_deltas(book: Book, shocks: Sequence[Shock] = SCENARIOS) -> DataFrame:
    """Rating and expected loss, base and shocked, per borrower and scenario."""
    shocked = [s for s in shocks if s.key != BASE.key]
    return shocked_positions(book, shocked).select(
        "scenario",
        "entity_id",
        rating_label("rating_base").alias("rating_base"),
        rating_label("rating").alias("rating_shocked"),
        "el_base",
        F.col("el").alias("el_shocked"),
        (F.col("el") - F.col("el_base")).cast("decimal(34,10)").alias("el_delta"),
    )
