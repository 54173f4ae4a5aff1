"""Default contagion over guarantees, for every group head at once."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook import params as P
from linkbook.book import Book
from linkbook.operators.exposure import PRINCIPAL
from linkbook.operators.mitigation import net_exposure
from linkbook.operators.ownership import group_members, top_level_names
from linkbook.plans.joins import merged
from linkbook.plans.staging import Growing, stage, stage_all
from linkbook.schema import SUM_MONEY

LOSS = "decimal(34,4)"
NET = "decimal(22,4)"


def _edges(book: Book) -> DataFrame:
    """Guarantees with their borrower, whatever the loan's status."""
    loans = book.loans.select(
        "loan_id", F.col("borrower_entity_id").alias("borrower"), PRINCIPAL, "status"
    )
    return book.active_guarantees.select(
        F.col("guarantor_entity_id").alias("guarantor"),
        F.col("beneficiary_loan_id").alias("loan_id"),
        "amount",
    ).join(loans, "loan_id")


def solvent_guaranteed_loans(book: Book, defaulted: DataFrame) -> DataFrame:
    """``seed, loan_id``: loans of a seed's defaulted borrowers with a guarantor outside its set.

    ``defaulted`` is ``seed, entity_id``.
    """
    edges = _edges(book).select("loan_id", "borrower", "guarantor")
    asked = edges.join(defaulted.withColumnRenamed("entity_id", "borrower"), "borrower")
    return (
        asked.join(
            defaulted.withColumnRenamed("entity_id", "guarantor"), ["seed", "guarantor"], "left_anti"
        )
        .select("seed", "loan_id")
        .distinct()
    )


def cascade(book: Book, lgd: Decimal = P.LGD) -> DataFrame:
    """Two-hop loss of every top-level group.

    A loan belongs to one top-level group, so membership is an equality of
    ultimate parents and no seed-by-loan table is built.
    """
    own = book.ownership.select("entity_id", "ubo")
    borrower = own.select(F.col("entity_id").alias("borrower"), F.col("ubo").alias("borrower_ubo"))
    guarantor = own.select(
        F.col("entity_id").alias("guarantor"), F.col("ubo").alias("guarantor_ubo")
    )
    guaranteed = (
        _edges(book)
        .filter(F.col("status") == "active")
        .join(guarantor, "guarantor", "left")
        .join(borrower, "borrower", "left")
        .select(
            "loan_id",
            PRINCIPAL,
            F.coalesce("guarantor_ubo", "guarantor").alias("guarantor_ubo"),
            F.coalesce("borrower_ubo", "borrower").alias("borrower_ubo"),
        )
        .filter(F.col("guarantor_ubo") != F.col("borrower_ubo"))
    )
    booked = (
        book.active_loans.groupBy(F.col("borrower_entity_id").alias("borrower"))
        .agg(F.sum(PRINCIPAL).alias("amount"))
        .join(borrower, "borrower", "left")
        .select(F.coalesce("borrower_ubo", "borrower").alias("seed"), "amount")
    )
    protected = (
        guaranteed.groupBy("loan_id")
        .agg(F.first("borrower_ubo").alias("seed"), F.first(PRINCIPAL).alias("amount"))
        .select("seed", "amount")
    )
    stripped = (
        guaranteed.groupBy(F.col("guarantor_ubo").alias("seed"), "loan_id")
        .agg(F.first(PRINCIPAL).alias("amount"))
        .select("seed", "amount")
    )
    zero = F.lit(0).cast(SUM_MONEY)
    arms = (
        booked.select("seed", F.col("amount").cast(SUM_MONEY).alias("direct"), zero.alias("lost"))
        .unionByName(
            protected.select(
                "seed", (-F.col("amount")).cast(SUM_MONEY).alias("direct"), zero.alias("lost")
            )
        )
        .unionByName(
            stripped.select(
                "seed", zero.alias("direct"), F.col("amount").cast(SUM_MONEY).alias("lost")
            )
        )
    )
    losses = arms.groupBy("seed").agg(F.sum("direct").alias("direct"), F.sum("lost").alias("lost"))
    sizes = own.groupBy(F.col("ubo").alias("seed")).agg(F.count("*").alias("group_size"))
    rate = F.lit(lgd)
    direct = (F.coalesce("direct", zero).cast(SUM_MONEY) * rate).cast(LOSS)
    lost = (F.coalesce("lost", zero).cast(SUM_MONEY) * rate).cast(LOSS)
    return (
        top_level_names(book)
        .select(F.col("head").alias("seed"))
        .join(sizes, "seed")
        .join(losses, "seed", "left")
        .select("seed", "group_size", direct.alias("direct_loss"), lost.alias("contagion_loss"))
        .withColumn("total_loss", (F.col("direct_loss") + F.col("contagion_loss")).cast(LOSS))
        .withColumn(
            "amplification",
            F.coalesce(
                F.try_divide(
                    F.col("total_loss").cast("double"), F.col("direct_loss").cast("double")
                ),
                F.lit(0.0),
            ),
        )
    )


@dataclass(frozen=True)
class _Units:
    """What a cascade needs to know of the groups and entities that can fail as a whole.

    ``inside``: ``unit, member``; ``facts``: ``unit, n, value, booked`` (entities, pledged collateral,
    active principal); ``held``: ``holder, unit`` and facts, a guarantor with the units that hold it;
    ``owed``: ``unit, guarantor, amount, net``, what the unit's borrowers make a guarantor outside it
    pay, and its net exposure.
    """

    inside: DataFrame
    held: DataFrame
    facts: DataFrame
    owed: DataFrame
    pledged: float


def _units(book: Book, edges: DataFrame, seeds: DataFrame, contagion_group: str) -> _Units:
    """Facts of every possible unit: a guarantor with what it takes down, or a seed with its group."""
    possible = edges.select(F.col("guarantor").alias("unit")).union(seeds.select(F.col("seed").alias("unit"))).distinct()
    members = group_members(book, contagion_group).select(F.col("head").alias("unit"), "member")
    inside = merged(stage(members.join(merged(possible), "unit", "left_semi"), "inside"))
    guarantors = edges.select(F.col("guarantor").alias("member")).distinct()
    held = inside.join(guarantors, "member", "left_semi").select(F.col("unit").alias("holder"), F.col("member").alias("unit"))
    pledges = (
        book.items.filter(F.col("status") == "active")
        .groupBy(F.col("pledged_by_entity_id").alias("member"))
        .agg(F.sum(F.coalesce("collateral_value", F.lit(0))).cast(SUM_MONEY).alias("value"))
    )
    booked = book.active_loans.groupBy(F.col("borrower_entity_id").alias("member")).agg(
        F.sum(PRINCIPAL).cast(SUM_MONEY).alias("booked")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(SUM_MONEY).alias(c)
    facts = lambda: (
        inside.join(merged(pledges), "member", "left")
        .join(merged(booked), "member", "left")
        .groupBy("unit")
        .agg(F.count("*").alias("n"), total("value"), total("booked"))
    )
    by_borrower = edges.groupBy("borrower", "guarantor").agg(F.sum("amount").cast(SUM_MONEY).alias("amount"))
    net = net_exposure(book).select(F.col("entity_id").alias("guarantor"), "net")
    owed = (
        inside.withColumnRenamed("member", "borrower")
        .join(merged(by_borrower), "borrower")
        .groupBy("unit", "guarantor")
        .agg(F.sum("amount").cast(SUM_MONEY).alias("amount"))
        .join(merged(inside.withColumnRenamed("member", "guarantor")), ["unit", "guarantor"], "left_anti")
        .join(merged(net), "guarantor", "left")
        .select("unit", "guarantor", "amount", F.coalesce("net", F.lit(0)).cast(NET).alias("net"))
    )
    pledges, owed = stage_all({"pledges": pledges, "owed": owed})
    pledged = pledges.agg(F.sum("value")).first()[0] or 1
    facts = merged(stage(facts(), "facts"))
    return _Units(inside, stage(held.join(facts, "unit"), "held"), facts, owed, float(pledged))


# Of a seed when a unit failed: pledges dumped until then, and two sums that name the units in its set.
STATE = ["dumped", "name1", "name2"]
FAILED = ["seed", "unit", "sign", "n", "value", "booked", *STATE, "round"]


def _haircut(dumped: Column, pledged: float, sensitivity: float) -> Column:
    return F.least(F.lit(P.FIRESALE_CAP), F.lit(sensitivity) * dumped.cast("double") / F.lit(pledged))


def _named(n: int) -> Column:
    return F.sum(F.col("sign") * F.xxhash64(F.lit(n), "unit").cast("decimal(20,0)"))


def _standing(failed: DataFrame) -> DataFrame:
    """``seed, unit`` of the failed units that are not part of a larger one: together they are the seed's set."""
    return failed.groupBy("seed", "unit").agg(F.sum("sign").alias("sign")).filter("sign > 0").select("seed", "unit")


def cascade_state(
    book: Book,
    buffer_fraction: float = P.BUFFER_FRACTION,
    firesale_sensitivity: float = P.FIRESALE_SENSITIVITY,
    max_rounds: int | None = None,
    contagion_group: str = "ubo",
    edges: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, _Units]:
    """The fixed point of all seeds: failed units, the seeds that share a run, and facts of the units.

    ``failed`` has a row per seed and failed unit: a whole group, or one entity of a group that
    stands. A unit that swallows earlier ones is followed by their rows with sign -1. ``shared`` is
    ``seed, run``: the seed's set equals that of ``run``, whose rows go on alone.
    """
    spark = book.loans.sparkSession
    edges = stage(_edges(book), "edges") if edges is None else edges
    seeds = top_level_names(book).select(F.col("head").alias("seed"))
    units = _units(book, edges, seeds, contagion_group)
    zero = {"dumped": F.lit(0).cast(SUM_MONEY), "name1": F.lit(0).cast("decimal(38,0)"), "name2": F.lit(0).cast("decimal(38,0)")}
    first = seeds.select("seed", F.col("seed").alias("unit"), F.lit(1).alias("sign")).join(units.facts, "unit")
    failed = Growing(spark, "failed", first.withColumns(zero).withColumn("round", F.lit(0)).select(*FAILED))
    fresh, owing, round_no = failed.rows(), None, 0
    fixed = {"fraction": buffer_fraction, "sensitivity": firesale_sensitivity, "cap": P.FIRESALE_CAP, "pledged": units.pledged}
    while True:
        round_no += 1
        if owing is None:
            owing = stage(spark.sql(_OWING.format(carried="", fresh="{fresh}", owed="{owed}"), fresh=fresh, owed=units.owed), "owing")
        else:
            query = _OWING.format(carried=_CARRIED.format(failing=_FAILING, owing="{owing}"), fresh="{fresh}", owed="{owed}")
            owing = stage(spark.sql(query, fixed, fresh=fresh, owed=units.owed, owing=owing), "owing")
        query = _FALLING.format(failing=_FAILING, owing="{owing}", held="{held}", failed="{failed}")
        falling = spark.sql(query, fixed, owing=owing, held=units.held, failed=failed.rows())
        fresh = failed.append(falling.withColumn("round", F.lit(round_no)).select(*FAILED))
        if round_no == max_rounds or fresh.isEmpty():
            return failed.rows(), _shared(failed.rows()), units


# The rounds repeat their joins, and every broadcast passes through the driver, so they say MERGE.
# What guarantors owe for the seeds of which the last round added something; seeds with equal sets go on as one run.
_OWING = """
WITH moving AS (
  SELECT seed, CAST(first(dumped) + sum(sign * value) AS DECIMAL(30,2)) AS dumped,
    CAST(first(name1) + sum(sign * CAST(xxhash64(1, unit) AS DECIMAL(20,0))) AS DECIMAL(38,0)) AS name1,
    CAST(first(name2) + sum(sign * CAST(xxhash64(2, unit) AS DECIMAL(20,0))) AS DECIMAL(38,0)) AS name2
  FROM {fresh} GROUP BY seed),
runs AS (SELECT min(seed) AS seed, first(dumped) AS dumped, name1, name2 FROM moving GROUP BY name1, name2),
owing AS (
  SELECT seed, guarantor, CAST(sum(amount) AS DECIMAL(30,2)) AS amount, first(net) AS net FROM (
    SELECT /*+ MERGE(o) */ seed, guarantor, CAST(sign * amount AS DECIMAL(30,2)) AS amount, net FROM {fresh} JOIN {owed} o USING (unit){carried})
  GROUP BY seed, guarantor)
SELECT /*+ MERGE(runs) */ * FROM owing JOIN runs USING (seed)
"""
# Guarantors that owe more than the buffer, which shrinks with the fire sale.
_FAILING = """amount > CAST(round(:fraction * (1 - least(:cap, :sensitivity * CAST(dumped AS DOUBLE) / :pledged)), 12) AS DECIMAL(13,12)) * net"""
_CARRIED = """
    UNION ALL SELECT seed, guarantor, amount, net FROM {owing} WHERE NOT ({failing})"""
# Those of them that fall: neither in the seed's set already nor in a unit that fails in the same round.
# Units that failed before, inside a new one, are taken back.
_FALLING = """
WITH asked AS (SELECT seed, guarantor AS unit, dumped, name1, name2 FROM {owing} WHERE {failing}),
standing AS (SELECT seed, unit AS holder FROM {failed} GROUP BY seed, unit HAVING sum(sign) > 0),
holders AS (SELECT seed, holder, true AS old FROM standing UNION ALL SELECT seed, unit, false FROM asked),
new AS (
  SELECT /*+ MERGE(h, holders) */ seed, unit, first(n) AS n, first(value) AS value, first(booked) AS booked,
    first(dumped) AS dumped, first(name1) AS name1, first(name2) AS name2
  FROM asked JOIN {held} h USING (unit) LEFT JOIN holders USING (seed, holder)
  GROUP BY seed, unit HAVING NOT max(coalesce(old OR holder <> unit AND old IS NOT NULL, false)))
SELECT seed, unit, 1 AS sign, n, value, booked, dumped, name1, name2 FROM new
UNION ALL
SELECT /*+ MERGE(h, s) */ new.seed, h.unit, -1, h.n, h.value, h.booked, dumped, name1, name2
FROM new JOIN {held} h ON h.holder = new.unit AND h.unit <> h.holder
LEFT SEMI JOIN standing s ON s.seed = new.seed AND s.holder = h.unit
"""


def _shared(failed: DataFrame) -> DataFrame:
    """``seed, run`` where a round left a seed with the set of another, smaller one that moved too."""
    after = failed.groupBy("seed", "round").agg(
        *[(F.first(c) + _named(n)).alias(c) for n, c in ((1, "name1"), (2, "name2"))]
    )
    runs = after.groupBy("round", "name1", "name2").agg(F.min("seed").alias("run"))
    return after.join(merged(runs), ["round", "name1", "name2"]).filter("seed <> run").select("seed", "run")


def cascade_multiround(
    book: Book,
    buffer_fraction: float = P.BUFFER_FRACTION,
    firesale_sensitivity: float = P.FIRESALE_SENSITIVITY,
    max_rounds: int | None = None,
    lgd: Decimal = P.LGD,
    contagion_group: str = "ubo",
) -> DataFrame:
    """Cascade with fire sales, iterated to a fixed point for all seeds together.

    The state of a seed is the units that failed, a whole group or a single entity, and what the
    guarantors that stand owe. A round adds the obligations of the last round's units only and
    tests all that are owed against the buffer, as the fire-sale haircut grows. A seed leaves the
    loop when a round brings it nothing new, or when its set equals another seed's. With
    ``max_rounds``, seeds still moving then have ``converged`` false. Amounts, buffers and pledges
    are decimals, and the share of the net exposure that absorbs losses is one with twelve places.

    ``contagion_group="ubo"``: a failing guarantor below the top of its group takes
    down only itself; ``"closure"`` takes down everything it owns.
    """
    edges = stage(_edges(book), "edges")
    failed, shared, units = cascade_state(
        book, buffer_fraction, firesale_sensitivity, max_rounds, contagion_group, edges
    )
    cap = F.lit(max_rounds if max_rounds is not None else 1 << 30)
    # With a cap, the last round's failures no longer count in the haircut.
    before = F.when(F.col("round") < cap, F.col("sign") * F.col("value")).otherwise(F.lit(0).cast(SUM_MONEY))
    status = failed.groupBy("seed").agg(
        F.least(F.max("round") + 1, cap).alias("rounds"),
        (F.max("round") < cap).alias("converged"),
        F.sum(F.col("sign") * F.col("n")).alias("defaulted"),
        F.sum(F.col("sign") * F.col("booked")).cast(SUM_MONEY).alias("gross"),
        _haircut(F.sum(before).cast(SUM_MONEY), units.pledged, firesale_sensitivity).alias("haircut"),
    )
    initial = failed.filter("round = 0").select(F.col("seed").alias("asked"), F.col("n").alias("initial"))
    runs = initial.join(merged(_runs(shared)), "asked", "left").select("asked", "initial", F.coalesce("run", "asked").alias("seed"))
    standing = stage(_standing(failed), "standing")
    covered = _covered(standing.join(merged(runs.select("seed").distinct()), "seed", "left_semi"), units.inside, edges)
    effective = F.least(F.lit(1.0), F.lit(float(lgd)) + F.col("haircut"))
    exposed = (F.col("gross") - F.coalesce("covered", F.lit(0)).cast(SUM_MONEY)).cast("double")
    return (
        runs.join(merged(status), "seed")
        .join(merged(covered), "seed", "left")
        .select(
            F.col("asked").alias("seed"),
            "rounds",
            "defaulted",
            (F.col("defaulted") - F.col("initial")).alias("second_order"),
            (effective * exposed).alias("total_loss"),
            F.round("haircut", 3).alias("firesale_haircut"),
            "converged",
        )
    )


def _runs(shared: DataFrame) -> DataFrame:
    """``asked, run``: the run that a seed ended in, following runs that were shared later."""
    links = stage(shared.select(F.col("seed").alias("asked"), "run"), "runs")
    if links.isEmpty():
        return links
    while True:
        # A seed joins a run once, and that run has a smaller id: pointers double until none moves.
        onward = links.select(F.col("asked").alias("run"), F.col("run").alias("next"))
        moved = links.join(merged(onward), "run", "left").select("asked", F.coalesce("next", "run").alias("run"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "runs")
        links = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return links


def _covered(standing: DataFrame, inside: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, covered``: active loans to defaulted borrowers that a guarantor outside the seed's set backs."""
    live = edges.filter(F.col("status") == "active").select("loan_id", "borrower", "guarantor", PRINCIPAL)
    by_unit = inside.withColumnRenamed("member", "borrower").join(merged(live), "borrower")
    by_unit = by_unit.join(merged(inside.withColumnRenamed("member", "guarantor")), ["unit", "guarantor"], "left_anti")
    backed = standing.join(merged(by_unit), "unit").select("seed", "loan_id", "guarantor", PRINCIPAL)
    holders = inside.select(F.col("unit").alias("holder"), F.col("member").alias("guarantor"))
    gone = (
        backed.select("seed", "guarantor")
        .distinct()
        .join(merged(holders), "guarantor")
        .join(merged(standing.withColumnRenamed("unit", "holder")), ["seed", "holder"], "left_semi")
        .select("seed", "guarantor")
    )
    return (
        backed.join(merged(gone), ["seed", "guarantor"], "left_anti")
        .groupBy("seed", "loan_id")
        .agg(F.first(PRINCIPAL).alias("amount"))
        .groupBy("seed")
        .agg(F.sum("amount").cast(SUM_MONEY).alias("covered"))
    )
