"""Exposure profiles and credit integrals as array expressions (no UDF, no explode)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkbook import params as P


def horizon(tenor: Column) -> Column:
    return F.greatest(tenor, F.lit(1))


def hazard(pd: Column) -> Column:
    """Constant hazard of a one-year PD."""
    return (
        F.when(pd >= 1.0, F.lit(P.CERTAIN_DEFAULT_HAZARD))
        .when(pd > 0.0, -F.log(1.0 - pd))
        .otherwise(F.lit(0.0))
    )


def discount(t: Column, rate: float = P.DISCOUNT_RATE) -> Column:
    return F.exp(F.lit(-rate) * t)


def expected_exposure(ead: Column, tenor: Column, t: Column, vol: float = P.EXPOSURE_VOL) -> Column:
    return ead * (1.0 - t / horizon(tenor)) + 0.5 * (ead * vol * F.sqrt(t))


def band_width(ead: Column, t: Column, vol: float = P.EXPOSURE_VOL) -> Column:
    """Half of the diffusion band: potential future minus expected exposure."""
    return 0.5 * (ead * vol * F.sqrt(t))


def profile(ead: Column, tenor: Column, vol: float = P.EXPOSURE_VOL) -> Column:
    """Array of ``{t, ee, pfe}`` for the years 0..tenor."""

    def point(year: Column) -> Column:
        t = year.cast("double")
        ee = expected_exposure(ead, tenor, t, vol)
        return F.struct(
            year.alias("t"), ee.alias("ee"), (ee + band_width(ead, t, vol)).alias("pfe")
        )

    return F.transform(F.sequence(F.lit(0), horizon(tenor).cast("int")), point)


def yearly_sum(tenor: Column, first: int, term: Callable[[Column], Column]) -> Column:
    """Sum of ``term(t)`` over the years ``first``..tenor."""
    years = F.sequence(F.lit(first), horizon(tenor).cast("int"))
    return F.aggregate(years, F.lit(0.0), lambda acc, y: acc + term(y.cast("double")))


def marginal_pd(rate: Column, t: Column) -> Column:
    """Probability of default during the year ending at ``t``."""
    return F.exp(-rate * (t - 1.0)) - F.exp(-rate * t)


def lifetime_ecl(ead: Column, tenor: Column, pd: Column, lgd: float) -> Column:
    h = hazard(pd)
    total = yearly_sum(tenor, 1, lambda t: marginal_pd(h, t) * lgd * ead * discount(t))
    return F.when((ead <= 0) | (pd <= 0), F.lit(0.0)).otherwise(total)


def cva(ead: Column, tenor: Column, pd: Column, lgd: float) -> Column:
    h = hazard(pd)
    return yearly_sum(
        tenor,
        1,
        lambda t: lgd * expected_exposure(ead, tenor, t) * marginal_pd(h, t) * discount(t),
    )


def dva(ead: Column, tenor: Column, own_pd: float, lgd: float) -> Column:
    h = hazard(F.lit(own_pd))
    total = yearly_sum(
        tenor, 1, lambda t: lgd * band_width(ead, t) * marginal_pd(h, t) * discount(t)
    )
    return F.when((ead <= 0) | F.lit(own_pd <= 0), F.lit(0.0)).otherwise(total)


def fva(ead: Column, tenor: Column, spread: float = P.FUNDING_SPREAD) -> Column:
    return yearly_sum(
        tenor, 0, lambda t: expected_exposure(ead, tenor, t) * spread * discount(t)
    )


def mva(ead: Column, tenor: Column, spread: float = P.FUNDING_SPREAD) -> Column:
    return yearly_sum(tenor, 0, lambda t: 2.0 * band_width(ead, t) * spread * discount(t))


def kva(ead: Column, tenor: Column, risk_weight: Column) -> Column:
    ratio = float(P.CAPITAL_RATIO)
    return yearly_sum(
        tenor,
        0,
        lambda t: ratio
        * risk_weight
        * expected_exposure(ead, tenor, t)
        * P.COST_OF_CAPITAL
        * discount(t),
    )
