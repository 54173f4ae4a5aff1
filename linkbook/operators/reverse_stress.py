"""Reverse stress: the mildest shock of a family that reaches a target.

A grid of severities of both families runs as scenarios of one job; the smallest
severity at or above the target is an aggregate over that grid. Targets beyond any fixed
grid are searched for between the ends of the scale: metrics grow almost in a line, so a few
steps suffice, one job a step for all targets.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.operators.scenarios import BASE, Shock, bands_by_scenario, summary_by_scenario

METRICS = ("expected_loss", "capital", "capital_pct_eligible", "limit_breaches")
# The family searched by default for each metric.
DEFAULT_FAMILY = {
    "expected_loss": "downgrade",
    "capital": "downgrade",
    "capital_pct_eligible": "downgrade",
    "limit_breaches": "exposure",
}
FAMILIES = ("downgrade", "exposure")
MAX_SEVERITY = 6


def _shock(family: str, n: int) -> Shock:
    if family == "downgrade":
        return Shock(f"downgrade:{n}", notches=n)
    return Shock(f"exposure:{n}", exposure_factor=Decimal(10 + n) / Decimal(10))


def severity_shocks(max_severity: int = MAX_SEVERITY) -> list[Shock]:
    steps = range(1, max_severity + 1)
    return [BASE, *[_shock(family, n) for family in FAMILIES for n in steps]]


def severity_grid(book: Book, max_severity: int = MAX_SEVERITY) -> DataFrame:
    """``family, severity, metric, value``; the base has family ``base`` and severity 0."""
    return _values(book, severity_shocks(max_severity))


def _values(book: Book, shocks: list[Shock]) -> DataFrame:
    """The metrics under each shock, in the columns of :func:`severity_grid`."""
    credit = summary_by_scenario(book, shocks)
    # Downgrades leave exposures alone, so their breach counts are the base ones.
    bands = bands_by_scenario(book, shocks)
    values = credit.join(bands.select("scenario", "red"), "scenario").select(
        F.split("scenario", ":").alias("s"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                    for m, c in zip(
                        METRICS, ("total_el", "total_capital", "capital_pct_eligible", "red")
                    )
                ]
            )
        ),
    )
    return values.select(
        F.col("s")[0].alias("family"),
        F.coalesce(F.get("s", F.lit(1)).cast("int"), F.lit(0)).alias("severity"),
        "metric",
        "value",
    )


# No downgrade goes further than the scale; an uplift of 2 ** 14 steps is 1,638 times the exposure.
LARGEST = {"downgrade": len(P.RATING_ORDER) - 1, "exposure": 1 << 14}


def search(book: Book, targets: DataFrame, largest: dict[str, int] | None = None) -> DataFrame:
    """:func:`min_shock` without a grid to stay in: ``targets`` as there, answered up to ``largest``.

    Metrics do not fall as the severity grows. The targets are the question, a few rows. The first job
    evaluates every notch and the largest uplift; each further one, for every open target, where a line
    between the severities around it would reach it, the severity before that, and their geometric mean.
    """
    largest = largest or LARGEST
    ends = {"downgrade": list(range(1, largest["downgrade"] + 1)), "exposure": [1, largest["exposure"]]}
    known: dict[tuple[str, int], dict[str, float]] = {}

    def evaluate(wanted: set[tuple[str, int]]) -> None:
        for r in _values(book, [BASE, *[_shock(f, n) for f, n in sorted(wanted)]]).collect():
            known.setdefault((r["family"], r["severity"]), {})[r["metric"]] = r["value"]

    asked = [r.asDict() for r in targets.collect()]
    families = [r.get("family") or DEFAULT_FAMILY[r["metric"]] for r in asked]
    evaluate({(f, n) for f in set(families) for n in ends[f]})
    base = known["base", 0]
    open_ = {}
    for r, family in zip(asked, families, strict=True):
        goal = r["target"] if r.get("target") is not None else r["multiple"] * base[r["metric"]]
        open_[r["metric"], family, goal] = (0, None)  # below it, reached at
    while True:
        wanted = set()
        for metric, family, goal in open_:
            tried = sorted((n, v[metric]) for (f, n), v in known.items() if f == family)
            below = max((n for n, v in tried if v < goal), default=0)
            reached = min((n for n, v in tried if v >= goal), default=None)
            open_[metric, family, goal] = (below, reached)
            if reached is not None and reached - below > 1:
                wanted |= {(family, n) for n in _between(below, reached, *(dict([(0, base[metric]), *tried])[n] for n in (below, reached)), goal)}
        if not wanted:
            break
        evaluate(wanted)
    rows = []
    for (metric, family, goal), (below, reached) in open_.items():
        rows.append((metric, family, float(goal), float(base[metric]), reached, float(known[family, reached or below][metric]), below))
    answers = book.loans.sparkSession.createDataFrame(
        rows, "metric string, family string, target double, base_value double, severity int, achieved double, searched_to int"
    )
    return answers.select(
        "metric", "family", "target", "base_value", "severity", "achieved", F.col("severity").isNotNull().alias("feasible"),
        F.greatest("searched_to", F.coalesce("severity", F.lit(0))).alias("searched_to"), _label().alias("shock_label"),
    )


def _between(below: int, reached: int, low: float, high: float, goal: float) -> set[int]:
    """Severities to try next, all between the two."""
    guess = below + math.ceil((goal - low) / (high - low) * (reached - below)) if high > low else below + 1
    tried = (guess - 1, guess, math.isqrt(max(below, 1) * reached))
    return {min(max(n, below + 1), reached - 1) for n in tried}


def _label() -> Column:
    n = F.col("severity")
    return (
        F.when(n.isNull(), "not reachable within the search cap")
        .when(F.col("family") == "exposure", F.format_string("+%d%% exposure uplift", n * 10))
        .when(n == 1, "broad downgrade −1 notch")
        .otherwise(F.format_string("broad downgrade −%d notches", n))
    )


def min_shock(grid: DataFrame, targets: DataFrame) -> DataFrame:
    """Answer every target (``metric, target`` and optionally ``family``, ``multiple``).

    ``multiple`` sets the target as a multiple of the base value. Severity 0 is
    never tried, so a target already met answers 1; out of reach gives a null
    severity and the value at the grid's last one, ``searched_to``.
    """
    asked = targets
    for column, kind in (("family", "string"), ("target", "double"), ("multiple", "double")):
        if column not in asked.columns:
            asked = asked.withColumn(column, F.lit(None).cast(kind))
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_FAMILY.items() for x in kv])
    base = grid.filter(F.col("family") == "base").select(
        "metric", F.col("value").alias("base_value")
    )
    asked = (
        asked.withColumn("family", F.coalesce("family", default[F.col("metric")]))
        .join(base, "metric")
        .withColumn("target", F.coalesce("target", F.col("multiple") * F.col("base_value")))
        .select("metric", "family", "target", "base_value")
    )
    reached = F.col("value") >= F.col("target")
    out = (
        asked.join(grid, ["metric", "family"])
        .groupBy("metric", "family", "target", "base_value")
        .agg(
            F.min(F.when(reached, F.col("severity"))).alias("severity"),
            F.min_by("value", F.when(reached, F.col("severity"))).alias("at_severity"),
            F.max_by("value", "severity").alias("worst"),
            F.max("severity").alias("searched_to"),
        )
    )
    n = F.col("severity")
    return out.select(
        "metric",
        "family",
        "target",
        "base_value",
        "severity",
        F.coalesce("at_severity", "worst").alias("achieved"),
        n.isNotNull().alias("feasible"),
        "searched_to",
        _label().alias("shock_label"),
    )
