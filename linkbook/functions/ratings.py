"""Rating-scale column functions; parameters are inlined, so no lookup join is planned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkbook import params as P


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def rating_lookup(rating: str | Column, table: Mapping[str, Decimal], default: Decimal) -> Column:
    """Value of ``table`` for a grade, ``default`` for unknown or missing grades."""
    scale = max(-int(v.as_tuple().exponent) for v in [*table.values(), default])
    kind = f"decimal({scale + 2},{scale})"
    pairs = [x for grade, v in table.items() for x in (F.lit(grade), F.lit(v).cast(kind))]
    key = F.coalesce(_col(rating), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default).cast(kind))


def pd_for(rating: str | Column, table: Mapping[str, Decimal] | None = None) -> Column:
    return rating_lookup(rating, table or P.PD, P.UNRATED_PD)


def risk_weight_for(rating: str | Column, table: Mapping[str, Decimal] | None = None) -> Column:
    return rating_lookup(rating, table or P.RISK_WEIGHT, P.UNRATED_RISK_WEIGHT)


def notch_down(
    rating: str | Column, notches: int | Column, scale: Sequence[str] = P.RATING_ORDER
) -> Column:
    """Grade ``notches`` lower, floored at the worst; unknown and missing grades pass."""
    grade = _col(rating)
    steps = notches if isinstance(notches, Column) else F.lit(notches)
    grades = F.array(*[F.lit(g) for g in scale])
    position = F.array_position(grades, grade)
    lowered = F.least(position + steps, F.lit(len(scale)))
    return F.when(position > 0, F.get(grades, (lowered - 1).cast("int"))).otherwise(grade)


def rating_label(rating: str | Column) -> Column:
    """Grade for display; blank or missing is ``unrated``."""
    return F.coalesce(F.nullif(_col(rating), F.lit("")), F.lit("unrated"))


def stage_for(rating: str | Column) -> Column:
    """Provisioning stage: 3 worst grade, 2 sub-investment or unrated, else 1."""
    grade = _col(rating)
    return (
        F.when(grade.isin(*P.STAGE_3_GRADES), 3)
        .when(grade.isNull() | (grade == "") | grade.isin(*P.STAGE_2_GRADES), 2)
        .otherwise(1)
    )
