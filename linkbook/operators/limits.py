"""Limit utilisation, breaches, roll-ups and pre-deal checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.functions.ratings import rating_lookup
from linkbook.operators.exposure import connected_exposure, connected_vector, named
from linkbook.plans.staging import stage
from linkbook.schema import SUM_MONEY


def band(utilisation: Column, amber: Decimal = P.AMBER_FROM, red: Decimal = P.RED_FROM) -> Column:
    return (
        F.when(utilisation >= float(red), "red")
        .when(utilisation >= float(amber), "amber")
        .otherwise("green")
    )


def exact_band(connected: Column, limit: Column) -> Column:
    """Band by exact decimals, so a name at precisely 75 % or 100 % lands right."""
    return (
        F.when((limit > 0) & (connected >= limit * F.lit(P.RED_FROM)), "red")
        .when((limit > 0) & (connected >= limit * F.lit(P.AMBER_FROM)), "amber")
        .otherwise("green")
    )


def ratio(part: Column, whole: Column) -> Column:
    """Null-safe double ratio; zero when the whole is zero or unknown."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)
    )


def watchlist(book: Book, status_mode: str = "full", heads: DataFrame | None = None) -> DataFrame:
    """Connected exposure against limit for every limit, names without exposure included; of ``heads`` only, if given."""
    limits = book.limits if status_mode == "raw" else book.active_limits
    if heads is not None:
        limits = limits.join(heads.select(F.col("head").alias("entity_id")).distinct(), "entity_id", "left_semi")
    joined = (
        limits.select("limit_id", "entity_id", F.col("single_name_limit").alias("limit_amount"))
        .join(
            connected_exposure(book, status_mode, heads).select(
                F.col("head").alias("entity_id"), "connected"
            ),
            "entity_id",
            "left",
        )
        .withColumn("connected", F.coalesce("connected", F.lit(0)).cast(SUM_MONEY))
    )
    return named(joined, book, "entity_id", "entity_name").select(
        "entity_id",
        "entity_name",
        "limit_id",
        "connected",
        "limit_amount",
        ratio(F.col("connected"), F.col("limit_amount")).alias("utilisation"),
        exact_band(F.col("connected"), F.col("limit_amount")).alias("band"),
    )


def limit_breaches(book: Book, heads: DataFrame | None = None) -> DataFrame:
    """Active limits met or exceeded; zero limits never breach."""
    return watchlist(book, heads=heads).filter(F.col("band") == "red")


def near_limit(book: Book, threshold: float | Decimal = P.AMBER_FROM) -> DataFrame:
    """Names at or above ``threshold`` of their limit, on full connected exposure."""
    share = F.lit(Decimal(str(threshold)))
    return watchlist(book).filter(
        (F.col("limit_amount") > 0) & (F.col("connected") >= F.col("limit_amount") * share)
    )


def band_counts(watch: DataFrame) -> DataFrame:
    """One row: red, amber and green counts."""
    return watch.agg(
        *[F.count_if(F.col("band") == b).alias(b) for b in ("red", "amber", "green")]
    )


def ubo_aggregation(book: Book, counterparties: DataFrame | None = None) -> DataFrame:
    """Every limited member of a counterparty's ultimate group, the parent flagged.

    Without ``counterparties`` (an ``entity_id`` column) all groups are listed.
    """
    own = book.ownership.select("entity_id", "ubo")
    rows = watchlist(book).join(own, "entity_id", "left")
    rows = rows.withColumn("ubo", F.coalesce("ubo", "entity_id"))
    if counterparties is not None:
        asked = counterparties.select("entity_id").join(own, "entity_id").select("ubo").distinct()
        rows = rows.join(asked, "ubo", "left_semi")
    return rows.select(
        "ubo",
        "entity_id",
        "entity_name",
        (F.col("entity_id") == F.col("ubo")).alias("is_ubo"),
        "connected",
        "limit_amount",
        "utilisation",
        "band",
    )


def first_limits(book: Book) -> DataFrame:
    """One limit per entity, the lowest ``limit_id``; a zero limit is none, for it never breaches."""
    first = book.active_limits.groupBy("entity_id").agg(
        F.min_by("single_name_limit", "limit_id").alias("limit_amount")
    )
    return first.filter(F.col("limit_amount") > 0)


def subsidiary_breach_check(book: Book) -> DataFrame:
    """Per group with more than one member: the head's strict breach and its subsidiaries' count."""
    own = book.ownership.select("entity_id", "ubo")
    connected = connected_exposure(book).select(F.col("head").alias("entity_id"), "connected")
    rows = (
        own.join(connected, "entity_id", "left")
        .join(first_limits(book), "entity_id", "left")
        .withColumn("connected", F.coalesce("connected", F.lit(0)).cast(SUM_MONEY))
    )
    is_head = F.col("entity_id") == F.col("ubo")
    return (
        rows.groupBy(F.col("ubo").alias("head"))
        .agg(
            F.max(F.when(is_head, F.col("connected"))).alias("ubo_connected"),
            F.max(F.when(is_head, F.col("limit_amount"))).alias("ubo_limit"),
            F.count_if(~is_head).alias("subsidiaries"),
            F.count_if(~is_head & (F.col("connected") >= F.col("limit_amount"))).alias(
                "subsidiary_breaches"
            ),
        )
        .filter(F.col("subsidiaries") > 0)
        .withColumn(
            "ubo_breaches",
            F.coalesce(F.col("ubo_connected") > F.col("ubo_limit"), F.lit(False)),
        )
    )


def breaching_subsidiaries(book: Book) -> DataFrame:
    """``head, entity_id``: the subsidiaries counted above, one row each."""
    own = book.ownership.select("entity_id", F.col("ubo").alias("head")).filter("entity_id != head")
    connected = connected_exposure(book).select(F.col("head").alias("entity_id"), "connected")
    return (
        own.join(first_limits(book), "entity_id")
        .join(connected, "entity_id")
        .filter(F.col("connected") >= F.col("limit_amount"))
        .select("head", "entity_id", "connected", "limit_amount")
    )


def pre_deal_check(
    book: Book,
    deals: DataFrame,
    tenor_cap: int = P.TENOR_CAP,
    settlement_fraction: Decimal = P.SETTLEMENT_FRACTION,
    factors: dict[str, Decimal] | None = None,
) -> DataFrame:
    """Verdict per proposed deal (``deal_id, borrower_id, amount, tenor``), nothing written.

    A known ultimate parent decides the rating even when it has none.
    """
    own = book.ownership.select(F.col("entity_id").alias("borrower_id"), "ubo")
    borrowers = deals.select("borrower_id").distinct().join(own, "borrower_id", "left")
    asked = stage(borrowers.select(F.coalesce("ubo", "borrower_id").alias("head")).distinct(), "asked")
    connected = connected_exposure(book, heads=asked).select(
        F.col("head").alias("ubo"), F.col("connected").alias("connected_now")
    )
    limits = first_limits(book)
    ratings = book.entities.select("entity_id", "rating", F.lit(True).alias("known"))

    def prefixed(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(
            F.col("entity_id").alias(key),
            *[F.col(c).alias(prefix + c) for c in df.columns if c != "entity_id"],
        )

    facts = (
        deals.select("deal_id", "borrower_id", F.col("amount").cast("decimal(20,2)"), "tenor")
        .join(own, "borrower_id", "left")
        .withColumn("ubo", F.coalesce("ubo", "borrower_id"))
        .join(connected, "ubo", "left")
        .join(prefixed(limits, "ubo", "u_"), "ubo", "left")
        .join(prefixed(limits, "borrower_id", "b_"), "borrower_id", "left")
        .join(prefixed(ratings, "ubo", "u_"), "ubo", "left")
        .join(prefixed(ratings, "borrower_id", "b_"), "borrower_id", "left")
    )
    zero = F.lit(0).cast("decimal(20,2)")
    rating = F.when(F.col("u_known"), F.col("u_rating")).otherwise(F.col("b_rating"))
    base = F.coalesce(F.nullif("u_limit_amount", zero), F.nullif("b_limit_amount", zero), zero)
    factor = rating_lookup("rating", factors or P.LIMIT_FACTOR, P.DEFAULT_LIMIT_FACTOR)
    verdict = (
        facts.withColumn("rating", F.coalesce(F.nullif(rating, F.lit("")), F.lit("unrated")))
        .withColumn("connected_now", F.coalesce("connected_now", F.lit(0)).cast(SUM_MONEY))
        .withColumn("base_limit", base)
        .withColumn("effective_limit", (F.col("base_limit") * factor).cast("decimal(24,4)"))
        .withColumn("connected_post", (F.col("connected_now") + F.col("amount")).cast(SUM_MONEY))
        .withColumn(
            "headroom", (F.col("effective_limit") - F.col("connected_post")).cast("decimal(34,4)")
        )
        .withColumn("limit_ok", F.col("connected_post") <= F.col("effective_limit"))
        .withColumn("tenor_cap", F.lit(tenor_cap))
        .withColumn("tenor_ok", F.col("tenor") <= F.col("tenor_cap"))
        .withColumn(
            "settlement_limit",
            (F.col("effective_limit") * F.lit(settlement_fraction)).cast("decimal(28,6)"),
        )
        .withColumn("settlement_ok", F.col("amount") <= F.col("settlement_limit"))
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                ~F.col("limit_ok"),
                F.format_string(
                    "connected limit: post-deal %s > %s",
                    F.col("connected_post").cast("string"),
                    F.col("effective_limit").cast("string"),
                ),
            ),
            F.when(
                ~F.col("tenor_ok"),
                F.format_string("tenor %sy exceeds the %sy cap", "tenor", "tenor_cap"),
            ),
            F.when(
                ~F.col("settlement_ok"),
                F.format_string(
                    "deal %s exceeds the settlement sub-limit %s",
                    F.col("amount").cast("string"),
                    F.col("settlement_limit").cast("string"),
                ),
            ),
        )
    )
    return verdict.select(
        "deal_id",
        "borrower_id",
        "ubo",
        "rating",
        "amount",
        "tenor",
        "connected_now",
        "base_limit",
        "effective_limit",
        "connected_post",
        "headroom",
        "limit_ok",
        "tenor_cap",
        "tenor_ok",
        "settlement_limit",
        "settlement_ok",
        (F.col("limit_ok") & F.col("tenor_ok") & F.col("settlement_ok")).alias("ok"),
        reasons.alias("reasons"),
    )


def limit_basis_utilisation(
    book: Book,
    capital_share: float = P.CAPITAL_BASIS_LIMIT,
    revenue_share: float = P.REVENUE_BASIS_LIMIT,
) -> DataFrame:
    """Connected exposure against the lender's capital and the name's own revenue."""
    capital = eligible_capital(book)
    revenue = book.entities.select(F.col("entity_id").alias("name"), "annual_revenue")
    return (
        connected_vector(book)
        .join(revenue, "name", "left")
        .withColumn("capital", capital)
        .select(
            "name",
            "exposure",
            F.try_divide(F.col("exposure").cast("double"), F.col("capital").cast("double")).alias(
                "of_capital"
            ),
            F.try_divide(
                F.col("exposure").cast("double"), F.col("annual_revenue").cast("double")
            ).alias("of_revenue"),
        )
        .withColumn("over_capital_basis", F.col("of_capital") > capital_share)
        .withColumn(
            "over_revenue_basis",
            F.coalesce(F.col("of_revenue") > revenue_share, F.lit(False)),
        )
    )


def eligible_capital(book: Book) -> Column:
    """The bank's capital as a scalar: lowest entity id with a non-zero value, else 1."""
    known = book.entities.filter(F.col("eligible_capital") != 0)
    return F.coalesce(
        known.agg(F.min_by("eligible_capital", "entity_id").alias("capital")).scalar(),
        F.lit(1).cast("decimal(20,2)"),
    )
