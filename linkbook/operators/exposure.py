"""Direct, connected and attributed exposure for every name at once.

Measures: exposure operators sum one or more loan amount columns in the same
pass, so a set of exposure shocks costs wider rows and no further scans.

Connected exposure never pairs up loans. A head's share of a collateral item is
the item total minus the part borrowed inside its group, which is linear in the
collateral rows even when one item secures a third of the book.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.operators.labels import common_owners, group_sums
from linkbook.operators.ownership import closure, top_level_names
from linkbook.plans.prefix import totals_before
from linkbook.plans.staging import stage
from linkbook.schema import SUM_MONEY

PRINCIPAL = "exposure_amount"
STATUS_MODES = ("raw", "loans", "full")

# Contribution labels.
DIRECT, GUARANTY, SHARED = "1. Direct loan", "2. Guaranty (contingent)", "3. Shared collateral"
NBFI_DIRECT, NBFI_GUARANTY, NBFI_SHARED = "1. direct", "2. guarantee cascade", "3. shared collateral"


def _money(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast(SUM_MONEY)


# --- facts by status mode ---------------------------------------------------


def _facts(book: Book, status_mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loans, guarantees and collateral that count under a status mode.

    ``raw`` ignores status, ``loans`` looks at loans only, ``full`` at all three.
    """
    if status_mode not in STATUS_MODES:
        raise ValueError(f"status_mode must be one of {STATUS_MODES}")
    loans = book.loans if status_mode == "raw" else book.active_loans
    if status_mode == "full":
        return loans, book.active_guarantees, book.active_collateral
    return loans, book.guarantees, book.collateral


def _pairs(collateral: DataFrame) -> DataFrame:
    return collateral.select(
        F.col("collateral_id").alias("item"), F.col("securing_loan_id").alias("loan_id")
    ).distinct()


def _with_path(df: DataFrame, book: Book, id_column: str, path: str) -> DataFrame:
    """Attach the ancestor path of ``id_column``; an unknown entity is its own path."""
    paths = book.ownership.select(F.col("entity_id").alias(id_column), F.col("path").alias(path))
    return df.join(paths, id_column, "left").withColumn(
        path, F.coalesce(path, F.array(id_column))
    )


def _with_heads(df: DataFrame, book: Book, id_column: str) -> DataFrame:
    """``df`` once for each owner of ``id_column``: ``head``, and ``hop``, 0 for itself; unknown entities own themselves."""
    if not book.deep:
        placed = _with_path(df, book, id_column, "_path")
        return placed.select("*", F.posexplode("_path").alias("hop", "head")).drop("_path")
    pairs = book.owner_pairs.select(F.col("member").alias(id_column), "head", F.col("depth").cast("int").alias("hop"))
    return df.join(pairs, id_column, "left").withColumns(
        {"head": F.coalesce("head", id_column), "hop": F.coalesce("hop", F.lit(0))}
    )


# --- direct -----------------------------------------------------------------


def direct_exposure(book: Book, measures: Sequence[str] = (PRINCIPAL,)) -> DataFrame:
    """Active principal per exact borrower: ``entity_id`` and one column per measure."""
    return book.active_loans.groupBy(F.col("borrower_entity_id").alias("entity_id")).agg(
        *[_money(m).alias(m) for m in measures]
    )


def direct_vector(book: Book, measures: Sequence[str] = (PRINCIPAL,)) -> DataFrame:
    """Direct exposure per borrower, lenders excluded; ``name`` and the measures."""
    return (
        direct_exposure(book, measures)
        .join(book.lenders, "entity_id", "left_anti")
        .withColumnRenamed("entity_id", "name")
    )


# --- connected --------------------------------------------------------------


def _zeros(prefix: str, measures: Sequence[str]) -> list[Column]:
    return [F.lit(0).cast(SUM_MONEY).alias(f"{prefix}{m}") for m in measures]


def _direct_arm(loans: DataFrame, book: Book, measures: Sequence[str]) -> DataFrame:
    by_borrower = loans.groupBy("borrower_entity_id").agg(*[_money(m).alias(m) for m in measures])
    return _with_heads(by_borrower, book, "borrower_entity_id").select(
        "head",
        *[F.when(F.col("hop") == 0, F.col(m)).otherwise(0).cast(SUM_MONEY).alias(f"own_{m}") for m in measures],
        *[F.col(m).alias(f"direct_{m}") for m in measures],
        F.lit(0).cast(SUM_MONEY).alias("guarantees_given"),
        *_zeros("shared_", measures),
    )


def _guarantee_arm(
    guarantees: DataFrame,
    loans: DataFrame,
    book: Book,
    measures: Sequence[str],
    inside_too: bool,
) -> DataFrame:
    if inside_too:
        edges = guarantees.groupBy("guarantor_entity_id").agg(_money("amount").alias("amount"))
        heads = F.col("guarantor_path")
        placed = _with_path(edges, book, "guarantor_entity_id", "guarantor_path")
    else:
        borrowers = loans.select("loan_id", "borrower_entity_id")
        edges = (
            guarantees.withColumnRenamed("beneficiary_loan_id", "loan_id")
            .join(borrowers, "loan_id")
            .groupBy("guarantor_entity_id", "borrower_entity_id")
            .agg(_money("amount").alias("amount"))
        )
        placed = _with_path(edges, book, "guarantor_entity_id", "guarantor_path")
        placed = _with_path(placed, book, "borrower_entity_id", "borrower_path")
        heads = F.array_except("guarantor_path", "borrower_path")
    return placed.select(F.explode(heads).alias("head"), "amount").select(
        "head",
        *_zeros("own_", measures),
        *_zeros("direct_", measures),
        F.col("amount").alias("guarantees_given"),
        *_zeros("shared_", measures),
    )


def _touches(
    placed: DataFrame, book: Book, key: str, measures: Sequence[str], reach: DataFrame | None = None
) -> DataFrame:
    """``in_*`` per (key, head): the key's loans borrowed inside the head's group; of asked heads only with ``reach``."""
    by_borrower = placed.groupBy(key, "borrower_entity_id").agg(*[_money(m).alias(m) for m in measures])
    headed = (
        _with_heads(by_borrower, book, "borrower_entity_id")
        if reach is None
        else _reached(by_borrower, reach, "borrower_entity_id")
    )
    return (
        headed.groupBy(key, "head")
        .agg(*[_money(m).alias(f"in_{m}") for m in measures])
    )


def _totals(placed: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """``all_*`` per key, each loan once."""
    return placed.groupBy(key).agg(*[_money(m).alias(f"all_{m}") for m in measures])


def shared_pairs(collateral: DataFrame) -> DataFrame:
    """Distinct (item, loan) pairs of items that secure at least two loans."""
    shared = (
        collateral.groupBy(F.col("collateral_id").alias("item"))
        .agg(F.min("securing_loan_id").alias("lo"), F.max("securing_loan_id").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("item")
    )
    return _pairs(collateral).join(shared, "item", "left_semi")


def _shared_links(
    book: Book, status_mode: str, measures: Sequence[str]
) -> tuple[DataFrame, bool]:
    """Loans behind shared items, written once per book: ``item, loan_id, borrower_entity_id`` and the measures.

    Also whether any loan has two shared items.
    """
    cache = book.__dict__.setdefault("_shared_links", {})
    key = (status_mode, tuple(measures))
    if key not in cache:
        loans, _, collateral = _facts(book, status_mode)
        secured = shared_pairs(collateral).join(
            loans.select("loan_id", "borrower_entity_id", *measures), "loan_id"
        )
        links = stage(secured.select("item", "loan_id", "borrower_entity_id", *measures), "links")
        several = not links.groupBy("loan_id").count().filter("count > 1").isEmpty()
        cache[key] = (links, several)
    return cache[key]


def _shared_arm(
    book: Book, status_mode: str, measures: Sequence[str], reach: DataFrame | None = None
) -> DataFrame:
    """Outside loans that share an item with a group loan, each loan once per head.

    A loan's items are ordered by how many heads touch them, the widest first. A head
    meets the loan at the first of them that it touches. First items: their loans'
    total minus the group's own part. Later ones: see :func:`_later_meetings`.
    """
    if reach is None:
        links, several = _shared_links(book, status_mode, measures)
    else:
        links, several = _asked_links(book, status_mode, measures, reach)
    touch = _touches(links, book, "item", measures, reach)
    first = links
    if several:
        placed = _by_reach(links, touch)
        first = placed.filter("place = 1")
    own = _touches(first, book, "item", measures, reach) if several else touch
    amounts = (
        touch.select("item", "head")
        .join(_totals(first, "item", measures), "item")
        .join(own, ["item", "head"], "left")
        .select(
            "head",
            *[
                (F.col(f"all_{m}") - F.coalesce(f"in_{m}", F.lit(0))).cast(SUM_MONEY).alias(m)
                for m in measures
            ],
        )
    )
    if several:
        amounts = amounts.unionByName(_later_meetings(placed, touch, measures))
    return amounts.select(
        "head",
        *_zeros("own_", measures),
        *_zeros("direct_", measures),
        F.lit(0).cast(SUM_MONEY).alias("guarantees_given"),
        *[F.col(m).alias(f"shared_{m}") for m in measures],
    )


def _by_reach(links: DataFrame, touch: DataFrame) -> DataFrame:
    """``links`` with each item's place in its loan's order, and a name of the items up to it.

    Two running 64-bit sums and the place name that set of items (a 128-bit
    fingerprint); loans with the same first items share it.
    """
    reach = touch.groupBy("item").agg(F.count("*").alias("heads"))
    order = Window.partitionBy("loan_id").orderBy(F.desc("heads"), "item")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda n: F.sum(F.xxhash64(F.lit(n), "item").cast("decimal(38,0)")).over(running)
    placed = links.join(reach, "item").withColumn("place", F.row_number().over(order))
    return placed.withColumn("prefix", F.concat_ws(":", "place", part(1), part(2))).drop("heads")


def _later_meetings(placed: DataFrame, touch: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Loans that a head meets at their second or a later item: ``head`` and the measures.

    Loans with the same items up to there are one row, so a pair of wide items is
    expanded once and not once per set of items. Such a head has no loan of its own
    among them: it would touch their first item.
    """
    nodes = placed.filter("place > 1").groupBy("prefix", "item", "place").agg(
        F.min("loan_id").alias("one_loan"), *[F.sum(m).alias(m) for m in measures]
    )
    met = nodes.join(touch.select("item", "head"), "item")
    before = (
        nodes.select("prefix", "place", "one_loan")
        .join(
            placed.select(
                F.col("loan_id").alias("one_loan"), F.col("item").alias("earlier"), F.col("place").alias("at")
            ),
            "one_loan",
        )
        .filter("at < place")
        .select("prefix", "earlier")
    )
    already = (
        met.select("prefix", "head")
        .join(before, "prefix")
        .join(touch.select(F.col("item").alias("earlier"), "head"), ["earlier", "head"], "left_semi")
        .select("prefix", "head")
        .distinct()
    )
    return met.join(already, ["prefix", "head"], "left_anti").select(
        "head", *[F.col(m).cast(SUM_MONEY).alias(m) for m in measures]
    )


def _points(rows: DataFrame, node: str, values: dict[str, Column], names: Sequence[str], count: int) -> DataFrame:
    """Amounts at entities: ``node``, all of ``names`` (0 where ``values`` has none) and ``k``, how many facts they stand for."""
    zero = F.lit(0).cast(SUM_MONEY)
    return rows.select(
        F.col(node).alias("node"), *[values.get(n, zero).cast(SUM_MONEY).alias(n) for n in names], F.lit(count).cast("bigint").alias("k")
    )


def _deep_arms(book: Book, loans: DataFrame, guarantees: DataFrame, status_mode: str, measures: Sequence[str]) -> DataFrame:
    """The arms of connected exposure where chains of owners are long, as sums over ranges.

    A fact counts for all owners of an entity: it is put there, and the owners' sums are over their
    groups' ranges. A guarantee is taken back at the deepest common owner of guarantor and
    borrower, and so is an item's total at that of neighbouring borrowers, which leaves it
    counted once for every head that touches it. Rows grow with the facts, not with the depth.
    """
    labels = book.labels
    names = [f"{p}_{m}" for m in measures for p in ("own", "direct", "shared")] + ["guarantees_given"]
    by_borrower = loans.groupBy("borrower_entity_id").agg(*[_money(m).alias(m) for m in measures])
    direct = {f"direct_{m}": F.col(m) for m in measures}
    parts = [_points(by_borrower, "borrower_entity_id", direct, names, 1)]
    amount = {"guarantees_given": F.col("amount")}
    if status_mode == "raw":
        edges = guarantees.groupBy("guarantor_entity_id").agg(_money("amount").alias("amount"))
    else:
        borrowers = loans.select(F.col("loan_id").alias("beneficiary_loan_id"), "borrower_entity_id")
        edges = stage(
            guarantees.join(borrowers, "beneficiary_loan_id")
            .groupBy("guarantor_entity_id", "borrower_entity_id")
            .agg(_money("amount").alias("amount")),
            "edges",
        )
        met = common_owners(labels, edges, "guarantor_entity_id", "borrower_entity_id")
        parts.append(_points(met, "owner", {"guarantees_given": -F.col("amount")}, names, -1))
        # An entity outside the table meets only itself.
        same = edges.filter("guarantor_entity_id = borrower_entity_id").join(
            labels.nodes.select(F.col("node").alias("guarantor_entity_id")), "guarantor_entity_id", "left_anti"
        )
        parts.append(_points(same, "guarantor_entity_id", {"guarantees_given": -F.col("amount")}, names, -1))
    parts.append(_points(edges, "guarantor_entity_id", amount, names, 1))
    links, several = _shared_links(book, status_mode, measures)
    if not several:
        own = links.groupBy("item", "borrower_entity_id").agg(*[_money(m).alias(f"in_{m}") for m in measures])
        held = own.join(_totals(links, "item", measures), "item").withColumn("one", F.lit(1).cast("bigint"))
        enter = labels.nodes.select(F.col("node").alias("borrower_entity_id"), "enter")
        placed = held.join(enter, "borrower_entity_id", "left")
        # Unknown borrowers come last in their item, by id; they share no owner with anyone.
        rows = stage(totals_before(placed, ["item", "enter", "borrower_entity_id"], {"at": "one"}, "touching"), "touching")
        outside = {f"shared_{m}": F.col(f"all_{m}") - F.col(f"in_{m}") for m in measures}
        parts.append(_points(rows, "borrower_entity_id", outside, names, 1))
        following = rows.select((F.col("at") - 1).alias("at"), F.col("item").alias("_item"), F.col("borrower_entity_id").alias("_next"))
        pairs = stage(rows.join(following, "at").filter("item = _item").drop("_item", "at", "one", "enter"), "neighbours")
        met = common_owners(labels, pairs, "borrower_entity_id", "_next")
        parts.append(_points(met, "owner", {f"shared_{m}": -F.col(f"all_{m}") for m in measures}, names, -1))
    points = reduce(DataFrame.unionByName, parts).groupBy("node").agg(*[_money(n).alias(n) for n in names], F.sum("k").alias("k"))
    points = stage(points, "points")
    sums = group_sums(labels, points, [*names, "k"])
    unknown = points.join(labels.nodes.select("node"), "node", "left_anti")
    columns = ["head", *[f"own_{m}" for m in measures], *[f"direct_{m}" for m in measures], "guarantees_given", *[f"shared_{m}" for m in measures]]
    groups = sums.unionByName(unknown).filter("k > 0").withColumnRenamed("node", "head").select(*[F.col(c) if c == "head" else F.col(c).cast(SUM_MONEY).alias(c) for c in columns])
    heads = by_borrower.select(
        F.col("borrower_entity_id").alias("head"), *[F.col(m).alias(f"own_{m}") for m in measures], *_zeros("direct_", measures),
        F.lit(0).cast(SUM_MONEY).alias("guarantees_given"), *_zeros("shared_", measures),
    )
    arms = groups.unionByName(heads)
    return arms.unionByName(_shared_arm(book, status_mode, measures)) if several else arms


def group_reach(book: Book, asked: DataFrame) -> DataFrame:
    """``entity_id, head, hop``: who is in the groups of the heads in ``asked``, each head itself included; staged."""
    # A head that is no entity is its own group.
    own = asked.select(F.col("head").alias("entity_id"), "head", F.lit(0).alias("hop"))
    below = closure(book).filter("depth > 0").join(asked, "head", "left_semi")
    return stage(
        below.select(F.col("member").alias("entity_id"), "head", F.col("depth").cast("int").alias("hop")).unionByName(own), "reach"
    )


def _reached(df: DataFrame, reach: DataFrame, id_column: str) -> DataFrame:
    """``df`` once for each asked head of ``id_column``."""
    return df.join(reach.withColumnRenamed("entity_id", id_column), id_column)


def _asked_arms(
    book: Book, loans: DataFrame, guarantees: DataFrame, status_mode: str, measures: Sequence[str], reach: DataFrame
) -> DataFrame:
    """The arms of connected exposure for the heads of ``reach`` alone.

    Their members come first: only loans to members, guarantees by members and items that secure
    members' loans are read further, so rows grow with the groups asked for and not with the book.
    """
    zero = F.lit(0).cast(SUM_MONEY)
    members = reach.select("entity_id").distinct()
    member_loans = loans.join(members.withColumnRenamed("entity_id", "borrower_entity_id"), "borrower_entity_id", "left_semi")
    by_borrower = member_loans.groupBy("borrower_entity_id").agg(*[_money(m).alias(m) for m in measures])
    direct = _reached(by_borrower, reach, "borrower_entity_id").select(
        "head",
        *[F.when(F.col("hop") == 0, F.col(m)).otherwise(0).cast(SUM_MONEY).alias(f"own_{m}") for m in measures],
        *[F.col(m).alias(f"direct_{m}") for m in measures],
        zero.alias("guarantees_given"),
        *_zeros("shared_", measures),
    )
    given = guarantees.join(members.withColumnRenamed("entity_id", "guarantor_entity_id"), "guarantor_entity_id", "left_semi")
    if status_mode == "raw":
        edges = given.groupBy("guarantor_entity_id").agg(_money("amount").alias("amount"))
        outside = _reached(edges, reach, "guarantor_entity_id")
    else:
        edges = (
            given.withColumnRenamed("beneficiary_loan_id", "loan_id")
            .join(loans.select("loan_id", "borrower_entity_id"), "loan_id")
            .groupBy("guarantor_entity_id", "borrower_entity_id")
            .agg(_money("amount").alias("amount"))
        )
        inside = reach.select(F.col("entity_id").alias("borrower_entity_id"), "head")
        outside = _reached(edges, reach, "guarantor_entity_id").join(inside, ["borrower_entity_id", "head"], "left_anti")
    guaranteed = outside.select(
        "head", *_zeros("own_", measures), *_zeros("direct_", measures), F.col("amount").alias("guarantees_given"), *_zeros("shared_", measures)
    )
    return direct.unionByName(guaranteed).unionByName(_shared_arm(book, status_mode, measures, reach))


def _asked_links(
    book: Book, status_mode: str, measures: Sequence[str], reach: DataFrame
) -> tuple[DataFrame, bool]:
    """:func:`_shared_links` of the items that secure a loan of an asked group."""
    loans, _, collateral = _facts(book, status_mode)
    members = reach.select(F.col("entity_id").alias("borrower_entity_id")).distinct()
    own = loans.join(members, "borrower_entity_id", "left_semi").select("loan_id")
    touched = _pairs(collateral).join(own, "loan_id", "left_semi").select("item").distinct()
    pairs = _pairs(collateral).join(touched, "item", "left_semi")
    secured = pairs.join(loans.select("loan_id", "borrower_entity_id", *measures), "loan_id")
    links = stage(secured.select("item", "loan_id", "borrower_entity_id", *measures), "links")
    return links, not links.groupBy("loan_id").count().filter("count > 1").isEmpty()


def connected_parts(
    book: Book,
    measures: Sequence[str] = (PRINCIPAL,),
    status_mode: str = "full",
    heads: DataFrame | None = None,
) -> DataFrame:
    """Connected exposure of every head, per measure; of ``heads`` only, if given.

    Columns: ``head``, ``guarantees_given`` and, for each measure ``m``, ``own_m``
    (loans to the head itself), ``direct_m`` (to its group) and ``shared_m``.
    """
    loans, guarantees, _ = _facts(book, status_mode)
    inside_too = status_mode == "raw"
    if heads is not None:
        arms = _asked_arms(book, loans, guarantees, status_mode, measures, group_reach(book, heads.select("head").distinct()))
    elif book.deep:
        arms = _deep_arms(book, loans, guarantees, status_mode, measures)
    else:
        arms = (
            _direct_arm(loans, book, measures)
            .unionByName(_guarantee_arm(guarantees, loans, book, measures, inside_too))
            .unionByName(_shared_arm(book, status_mode, measures))
        )
    return arms.groupBy("head").agg(
        _money("guarantees_given").alias("guarantees_given"),
        *[_money(f"{p}_{m}").alias(f"{p}_{m}") for m in measures for p in ("own", "direct", "shared")],
    )


def connected_total(measure: str = PRINCIPAL) -> Column:
    """Total of the three parts for one measure of :func:`connected_parts`."""
    return (
        F.col(f"direct_{measure}") + F.col("guarantees_given") + F.col(f"shared_{measure}")
    ).cast(SUM_MONEY)


def connected_exposure(
    book: Book, status_mode: str = "full", heads: DataFrame | None = None
) -> DataFrame:
    """``head, direct_head_only, direct, guarantees_given, shared_collateral, connected``."""
    return connected_parts(book, (PRINCIPAL,), status_mode, heads).select(
        "head",
        F.col(f"own_{PRINCIPAL}").alias("direct_head_only"),
        F.col(f"direct_{PRINCIPAL}").alias("direct"),
        "guarantees_given",
        F.col(f"shared_{PRINCIPAL}").alias("shared_collateral"),
        connected_total().alias("connected"),
    )


def connected_vector(book: Book, status_mode: str = "full") -> DataFrame:
    """``name, exposure``: connected exposure of every top-level name, zero included."""
    return (
        top_level_names(book)
        .select("head")
        .join(connected_exposure(book, status_mode), "head", "left")
        .select(
            F.col("head").alias("name"),
            F.coalesce("connected", F.lit(0)).cast(SUM_MONEY).alias("exposure"),
        )
    )


def _asked(heads: DataFrame, column: str) -> DataFrame:
    """The distinct parameters, staged: several arms read them, and they may cost a query."""
    return stage(heads.select(column).distinct(), "asked")


def exposure_to_groups(book: Book, heads: DataFrame) -> DataFrame:
    """``head, connected`` for the heads asked for, counting active records only."""
    asked = _asked(heads, "head")
    return (
        asked.join(connected_exposure(book, heads=asked).select("head", "connected"), "head", "left")
        .select("head", F.coalesce("connected", F.lit(0)).cast(SUM_MONEY).alias("connected"))
    )


def headline(book: Book, heads: DataFrame | None = None, status_mode: str = "full") -> DataFrame:
    """Direct against connected exposure and the group limit, per head (strict breach)."""
    if heads is None:
        asked = top_level_names(book).select("head").distinct()
    else:
        asked = heads = _asked(heads, "head")
    limits = book.limits if status_mode == "raw" else book.active_limits
    group_limits = limits.groupBy(F.col("entity_id").alias("head")).agg(
        _money("single_name_limit").alias("group_limit")
    )
    zero = F.lit(0).cast(SUM_MONEY)
    return (
        asked.join(connected_exposure(book, status_mode, heads), "head", "left")
        .join(group_limits, "head", "left")
        .select(
            "head",
            F.coalesce("direct_head_only", zero).alias("direct_head_only"),
            F.coalesce("direct", zero).alias("direct_group"),
            F.coalesce("connected", zero).alias("connected"),
            F.coalesce("group_limit", zero).alias("group_limit"),
        )
        .withColumn("limit_breached", F.col("connected") > F.col("group_limit"))
        .withColumn("hidden", (F.col("connected") - F.col("direct_head_only")).cast(SUM_MONEY))
    )


# --- drill-down -------------------------------------------------------------


def named(df: DataFrame, book: Book, id_column: str, name_column: str) -> DataFrame:
    """Attach a display name; without one the id itself."""
    names = book.entities.select(
        F.col("entity_id").alias(id_column), F.col("entity_name").alias(name_column)
    )
    return df.join(names, id_column, "left").withColumn(
        name_column, F.coalesce(name_column, F.col(id_column).cast("string"))
    )


def _labelled(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix} "), F.col(column).cast("string"))


def breakdown(book: Book, heads: DataFrame, status_mode: str = "full") -> DataFrame:
    """One row per contributing path of the heads asked for.

    ``via`` is the record that makes the link and ``via_detail`` its label; ``outside_loan`` is the loan
    outside the group that a guarantee backs or an item also secures, null for the group's own loans.

    The rows are the drill-down itself, so pass the heads to look into; totals for
    all heads come from :func:`connected_exposure`.
    """
    loans, guarantees, collateral = _facts(book, status_mode)
    asked = _asked(heads, "head")
    members = group_reach(book, asked).drop("hop")
    loan = loans.select("loan_id", F.col("borrower_entity_id").alias("counterparty"), PRINCIPAL)
    member_loans = loan.join(members.withColumnRenamed("entity_id", "counterparty"), "counterparty")
    direct = member_loans.select(
        "head",
        F.lit(DIRECT).alias("contribution_type"),
        "counterparty",
        F.col(PRINCIPAL).alias("amount"),
        F.col("loan_id").cast("string").alias("via"),
        _labelled("Loan", "loan_id").alias("via_detail"),
        F.lit(None).cast("string").alias("outside_loan"),
    )
    given = (
        guarantees.select(
            "guarantee_id",
            F.col("guarantor_entity_id").alias("entity_id"),
            F.col("beneficiary_loan_id").alias("loan_id"),
            "amount",
        )
        .join(members, "entity_id")
        .join(loan, "loan_id")
    )
    inside = members.withColumnRenamed("entity_id", "counterparty")
    if status_mode != "raw":
        given = given.join(inside, ["counterparty", "head"], "left_anti")
    guaranteed = given.select(
        "head",
        F.lit(GUARANTY).alias("contribution_type"),
        "counterparty",
        "amount",
        F.col("guarantee_id").cast("string").alias("via"),
        _labelled("Guaranty", "guarantee_id").alias("via_detail"),
        F.col("loan_id").cast("string").alias("outside_loan"),
    )
    pairs = shared_pairs(collateral)
    touched = pairs.join(member_loans.select("loan_id", "head"), "loan_id").select("item", "head")
    shared = (
        touched.distinct()
        .join(pairs, "item")
        .join(loan, "loan_id")
        .join(inside, ["counterparty", "head"], "left_anti")
        .join(book.items.select(F.col("collateral_id").alias("item"), "collateral_type"), "item", "left")
        .select(
            "head",
            F.lit(SHARED).alias("contribution_type"),
            "counterparty",
            F.col(PRINCIPAL).alias("amount"),
            F.col("item").cast("string").alias("via"),
            F.col("collateral_type").alias("via_detail"),
            F.col("loan_id").cast("string").alias("outside_loan"),
        )
    )
    rows = direct.unionByName(guaranteed).unionByName(shared)
    return named(rows, book, "counterparty", "counterparty_name")


def nbfi_cascade(book: Book, nbfis: DataFrame) -> DataFrame:
    """Entity-level cascade of the NBFIs asked for (``nbfi`` column): one row per path.

    Own and collateral-sharing loans must be active; guarantees count whatever
    their status.
    """
    asked = _asked(nbfis, "nbfi")
    loan = book.active_loans.select("loan_id", "borrower_entity_id", PRINCIPAL)
    own_all = book.loans.select("loan_id", F.col("borrower_entity_id").alias("nbfi")).join(
        asked, "nbfi", "left_semi"
    )
    own = (
        loan.withColumnRenamed("borrower_entity_id", "nbfi")
        .join(asked, "nbfi", "left_semi")
        .select(
            "nbfi",
            F.lit(NBFI_DIRECT).alias("contribution_type"),
            F.col("nbfi").alias("counterparty"),
            F.col(PRINCIPAL).alias("amount"),
            F.col("loan_id").cast("string").alias("via"),
        )
    )
    guaranteed = (
        book.guarantees.select(
            "guarantee_id",
            F.col("guarantor_entity_id").alias("nbfi"),
            F.col("beneficiary_loan_id").alias("loan_id"),
            "amount",
        )
        .join(asked, "nbfi", "left_semi")
        .join(book.loans.select("loan_id", "borrower_entity_id"), "loan_id")
        .select(
            "nbfi",
            F.lit(NBFI_GUARANTY).alias("contribution_type"),
            F.col("borrower_entity_id").alias("counterparty"),
            "amount",
            F.col("guarantee_id").cast("string").alias("via"),
        )
    )
    pairs = shared_pairs(book.collateral)
    touched = pairs.join(own_all, "loan_id").select("item", "nbfi").distinct()
    shared = (
        touched.join(pairs, "item")
        .join(loan, "loan_id")
        .filter(F.col("borrower_entity_id") != F.col("nbfi"))
        .select(
            "nbfi",
            F.lit(NBFI_SHARED).alias("contribution_type"),
            F.col("borrower_entity_id").alias("counterparty"),
            F.col(PRINCIPAL).alias("amount"),
            F.col("item").cast("string").alias("via"),
        )
    )
    rows = own.unionByName(guaranteed).unionByName(shared).distinct()
    return named(rows, book, "counterparty", "counterparty_name")


def nbfi_cascade_totals(book: Book) -> DataFrame:
    """Cascade rows summed per NBFI and contribution, for every NBFI, without listing paths.

    Shared collateral counts a loan once per distinct (item amount, loan) path, as
    the path listing does: item total minus the NBFI's own active part, per touched item.
    """
    nbfi = book.entities.filter(F.col("counterparty_type") == "nbfi").select(
        F.col("entity_id").alias("nbfi")
    )
    loan = book.active_loans.select("loan_id", "borrower_entity_id", PRINCIPAL)
    direct = (
        loan.groupBy(F.col("borrower_entity_id").alias("nbfi"))
        .agg(_money(PRINCIPAL).alias("amount"), F.count("*").alias("paths"))
        .join(nbfi, "nbfi", "left_semi")
        .withColumn("contribution_type", F.lit(NBFI_DIRECT))
    )
    guaranteed = (
        book.guarantees.withColumnRenamed("beneficiary_loan_id", "loan_id")
        .join(book.loans.select("loan_id"), "loan_id", "left_semi")
        .groupBy(F.col("guarantor_entity_id").alias("nbfi"))
        .agg(_money("amount").alias("amount"), F.count("*").alias("paths"))
        .join(nbfi, "nbfi", "left_semi")
        .withColumn("contribution_type", F.lit(NBFI_GUARANTY))
    )
    active = F.col("status") == "active"
    per_item = (
        shared_pairs(book.collateral)
        .join(book.loans.select("loan_id", "borrower_entity_id", PRINCIPAL, "status"), "loan_id")
        .groupBy("item", "borrower_entity_id")
        .agg(
            _money(F.when(active, F.col(PRINCIPAL))).alias("own"),
            F.count_if(active).alias("own_n"),
        )
    )
    per_item_total = per_item.groupBy("item").agg(
        _money("own").alias("total"), F.sum("own_n").alias("total_n")
    )
    shared = (
        per_item.withColumnRenamed("borrower_entity_id", "nbfi")
        .join(nbfi, "nbfi", "left_semi")
        .join(per_item_total, "item")
        .groupBy("nbfi")
        .agg(
            _money(F.col("total") - F.col("own")).alias("amount"),
            F.sum(F.col("total_n") - F.col("own_n")).alias("paths"),
        )
        .filter(F.col("paths") > 0)
        .withColumn("contribution_type", F.lit(NBFI_SHARED))
    )
    return (
        direct.unionByName(guaranteed)
        .unionByName(shared)
        .select("nbfi", "contribution_type", "amount", "paths")
    )


# --- risk-owner attribution -------------------------------------------------


def _rerouted(book: Book, measures: Sequence[str]) -> DataFrame:
    """Active loans guaranteed from another group: both owners and the measures.

    Among several such guarantees the lowest ``guarantee_id`` decides.
    """
    owner = book.ownership.select("entity_id", "ubo")
    guarantor = owner.select(
        F.col("entity_id").alias("guarantor_entity_id"), F.col("ubo").alias("guarantor_ubo")
    )
    borrower = owner.select(
        F.col("entity_id").alias("borrower_entity_id"), F.col("ubo").alias("borrower_ubo")
    )
    given = book.guarantees.select(
        "guarantee_id", "guarantor_entity_id", F.col("beneficiary_loan_id").alias("loan_id")
    )
    return (
        given.join(
            book.active_loans.select("loan_id", "borrower_entity_id", *measures), "loan_id"
        )
        .join(guarantor, "guarantor_entity_id", "left")
        .join(borrower, "borrower_entity_id", "left")
        .withColumn("guarantor_ubo", F.coalesce("guarantor_ubo", "guarantor_entity_id"))
        .withColumn("borrower_ubo", F.coalesce("borrower_ubo", "borrower_entity_id"))
        .filter(F.col("guarantor_ubo") != F.col("borrower_ubo"))
        .groupBy("loan_id")
        .agg(
            F.min_by("guarantor_ubo", "guarantee_id").alias("guarantor_ubo"),
            F.first("borrower_ubo").alias("borrower_ubo"),
            *[F.first(m).alias(m) for m in measures],
        )
    )


def risk_owners(book: Book) -> DataFrame:
    """``loan_id, owner, exposure``: the group that carries each active loan's risk."""
    owner = book.ownership.select(F.col("entity_id").alias("borrower_entity_id"), "ubo")
    return (
        book.active_loans.select("loan_id", "borrower_entity_id", PRINCIPAL)
        .join(owner, "borrower_entity_id", "left")
        .join(_rerouted(book, ()).select("loan_id", "guarantor_ubo"), "loan_id", "left")
        .select(
            "loan_id",
            F.coalesce("guarantor_ubo", "ubo", "borrower_entity_id").alias("owner"),
            F.col(PRINCIPAL).alias("exposure"),
        )
    )


def attributed_parts(book: Book, measures: Sequence[str] = (PRINCIPAL,)) -> DataFrame:
    """Exposure by risk owner, each loan once, per measure.

    Loans are summed by borrower first; the rerouted ones then move from the
    borrower's group to the guarantor's, so no loan-level owner table is shuffled.
    """
    by_borrower = book.active_loans.groupBy("borrower_entity_id").agg(
        *[_money(m).alias(m) for m in measures], F.count("*").alias("loans")
    )
    owner = book.ownership.select(F.col("entity_id").alias("borrower_entity_id"), "ubo")
    booked = by_borrower.join(owner, "borrower_entity_id", "left").select(
        F.coalesce("ubo", "borrower_entity_id").alias("owner"), *measures, "loans"
    )
    moved = _rerouted(book, measures)
    moves = moved.select(
        F.explode(
            F.array(
                F.struct(F.col("guarantor_ubo").alias("owner"), F.lit(1).alias("sign")),
                F.struct(F.col("borrower_ubo").alias("owner"), F.lit(-1).alias("sign")),
            )
        ).alias("move"),
        *measures,
    ).select(
        "move.owner",
        *[
            F.when(F.col("move.sign") > 0, F.col(m)).otherwise(-F.col(m)).cast(SUM_MONEY).alias(m)
            for m in measures
        ],
        F.col("move.sign").cast("bigint").alias("loans"),
    )
    return (
        booked.unionByName(moves)
        .groupBy("owner")
        .agg(*[_money(m).alias(m) for m in measures], F.sum("loans").alias("loans"))
        .filter(F.col("loans") > 0)
        .drop("loans")
    )


def attributed_vector(book: Book) -> DataFrame:
    """``owner, exposure``."""
    return attributed_parts(book).withColumnRenamed(PRINCIPAL, "exposure")


def attributed_view(book: Book) -> DataFrame:
    """Attributed exposure with the owner's name and sector."""
    labels = book.entities.select(F.col("entity_id").alias("owner"), "entity_name", "sector")
    return (
        attributed_vector(book)
        .join(labels, "owner", "left")
        .select(
            "owner",
            F.coalesce("entity_name", F.col("owner").cast("string")).alias("owner_name"),
            F.coalesce("sector", F.lit("")).alias("sector"),
            "exposure",
        )
    )


def top_counterparties(book: Book, k: int = 10) -> DataFrame:
    """The ``k`` largest risk owners."""
    top = attributed_vector(book).orderBy(F.desc("exposure"), F.asc("owner")).limit(k)
    return (
        named(top, book, "owner", "owner_name")
        .select("owner", "owner_name", "exposure")
        .orderBy(F.desc("exposure"), F.asc("owner"))
    )


def guarantee_chains(book: Book, heads: DataFrame | None = None) -> DataFrame:
    """Active guarantees whose guarantor or guaranteed borrower is in a head's group."""
    loan = book.loans.select(F.col("loan_id").alias("beneficiary_loan_id"), "borrower_entity_id")
    edges = book.active_guarantees.select(
        "guarantee_id", "guarantor_entity_id", "beneficiary_loan_id", "amount"
    ).join(loan, "beneficiary_loan_id")
    fields = ["guarantee_id", "guarantor_entity_id", "borrower_entity_id", "amount"]
    if book.deep:
        sides = [_with_heads(edges, book, side).select("head", *fields) for side in fields[1:3]]
        rows = sides[0].union(sides[1]).distinct()
    else:
        edges = _with_path(edges, book, "guarantor_entity_id", "guarantor_path")
        edges = _with_path(edges, book, "borrower_entity_id", "borrower_path")
        rows = edges.select(F.explode(F.array_union("guarantor_path", "borrower_path")).alias("head"), *fields)
    if heads is not None:
        rows = rows.join(heads.select("head").distinct(), "head", "left_semi")
    rows = named(rows, book, "guarantor_entity_id", "guarantor_name")
    return named(rows, book, "borrower_entity_id", "borrower_name")


def group_view(book: Book, heads: DataFrame) -> dict[str, DataFrame]:
    """Headline and contribution rows of the heads asked for."""
    return {"headline": headline(book, heads), "contributions": breakdown(book, heads)}
