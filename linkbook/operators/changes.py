"""Guarded batch changes: creates, amount updates, soft deletes, approvals and flags.

A batch is judged once and its verdicts are staged; the new tables and the outcome
both read them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkbook.book import Book
from linkbook.operators.limits import limit_breaches
from linkbook.operators.ownership import closure
from linkbook.operators.validation import (
    GUARANTEED_AMOUNT,
    LIMIT_AMOUNT,
    PRINCIPAL,
    accepted_rows,
    blank_records,
    keyed_records,
    record_id,
    references,
)
from linkbook.operators.wrong_way import structural_wwr
from linkbook.plans.staging import stage
from linkbook.schema import COLUMNS, DEFAULT_MATURITY, DEFAULT_STATUS, KEY, TABLES

SAFE_ID = r"^[A-Za-z0-9_\-]+$"
# Fields an amount update may touch, and where they live.
AMOUNT_FIELDS = {
    "principalAmount": ("loans", "exposure_amount", PRINCIPAL),
    "limitAmount": ("limits", "single_name_limit", LIMIT_AMOUNT),
    "guaranteedAmount": ("guarantees", "amount", GUARANTEED_AMOUNT),
}
# Record kinds of soft deletes, and roles that may approve.
KINDS = {
    "entity": "entities",
    "loan": "loans",
    "guaranty": "guarantees",
    "collateral": "collateral",
    "limit": "limits",
}
CHECKER_ROLES = ("group_risk",)
# Messages that outcomes and audit rows show.
BAD_UPDATE = "invalid subject id, predicate, or amount"
BAD_ID = "invalid subject id"
NOT_FOUND = "not found"
STILL_REFERENCED = (
    "entity still referenced by an active loan or guaranty; deactivate those first"
)
SWITCHED_OFF = ("status set to ", " (excluded from metrics; history preserved)")
BREACH_REASON = "connected %s >= limit %s"
WRONG_WAY_REASON = "collateral %s issued by same group %s as borrower"
NOT_PENDING = "no such pending change"
SAME_PERSON = "four-eyes: the checker must differ from the maker"


def _as_text(df: DataFrame, table: str) -> DataFrame:
    columns = [c for c in COLUMNS[table] if c in df.columns]
    missing = [F.lit(None).cast("string").alias(c) for c in COLUMNS[table] if c not in df.columns]
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns], *missing)


# --- creates ----------------------------------------------------------------


def apply_creates(
    book: Book, proposals: Mapping[str, DataFrame], strict: bool = True
) -> tuple[Book, DataFrame]:
    """Validate proposals against current plus proposed data and append the accepted ones.

    Returns the new book and ``table, record_id, accepted, reasons``. A proposal
    repeating a stored key must agree with it, and then adds nothing. New rows
    without a status are active, loans without a maturity get the default.
    """
    proposed = {
        t: _as_text(proposals[t], t) if t in proposals else _as_text(getattr(book, t), t).limit(0)
        for t in TABLES
    }
    proposed["loans"] = proposed["loans"].withColumn(
        "status", F.coalesce("status", F.lit(DEFAULT_STATUS))
    )
    # Only stored rows under a proposed key are checked again, and only referenced ids
    # are looked up, so a small batch costs a scan of the keys and no shuffle of the book.
    # Each is found once and written; every record of the candidates is a proposed one.
    candidates = {}
    for t in TABLES:
        candidates[t] = proposed[t]
        if t in proposals:
            stored = _as_text(getattr(book, t), t).join(proposed[t].select(KEY[t]), KEY[t], "left_semi")
            candidates[t] = stage(stored.select(*COLUMNS[t]), "stored").unionByName(proposed[t])
    named = stage(references(candidates).select("kind", "value").distinct(), "references")

    def answered(table: str, kind: str, *columns: str) -> tuple[DataFrame, DataFrame]:
        """The entities or loans that references name, and the references that name none."""
        values = named.filter(F.col("kind") == kind).select(F.col("value").alias(KEY[table]))
        keys = _as_text(getattr(book, table), table).unionByName(proposed[table]).filter(record_id(table) != "")
        known = stage(keys.select(KEY[table], *columns).join(values, KEY[table], "left_semi"), "known")
        lost = values.join(known, KEY[table], "left_anti")
        return known, lost.select(F.lit(kind).alias("kind"), F.col(KEY[table]).alias("value"))

    _, no_entity = answered("entities", "entity")
    loan_ids, no_loan = answered("loans", "loan", "borrower_entity_id")
    report = stage(
        keyed_records(candidates, strict, loan_ids, no_entity.unionByName(no_loan)).unionByName(
            blank_records(proposed)
        ),
        "report",
    )
    good = accepted_rows(proposed, report)
    tables = {}
    for t in proposals:
        stored = getattr(book, t)
        key = ["collateral_id", "securing_loan_id"] if t == "collateral" else [KEY[t]]
        typed = good[t].select(
            *[_restore(good[t], stored, c) for c in stored.columns]
        ).dropDuplicates(key)
        tables[t] = stored.unionByName(typed.join(stored.select(*key), key, "left_anti"))
    return book.with_tables(**tables), report


def _restore(df: DataFrame, stored: DataFrame, column: str) -> Column:
    kind = stored.schema[column].dataType
    value = F.col(column) if column in df.columns else F.lit(None).cast("string")
    if not isinstance(kind, T.StringType):
        value = value.try_cast(kind)
    if column == "status":
        value = F.coalesce(value, F.lit(DEFAULT_STATUS))
    if column == "maturity_years":
        value = F.coalesce(value, F.lit(DEFAULT_MATURITY))
    return value.alias(column)


# --- amount updates ---------------------------------------------------------


def apply_amounts(book: Book, changes: DataFrame) -> tuple[Book, DataFrame]:
    """Set amounts by id: ``change_id, subject_id, field, new_amount`` (text or number).

    Returns the new book and ``change_id, subject_id, field, accepted, reason``.
    The highest accepted ``change_id`` of a record wins.
    """
    known_fields = list(AMOUNT_FIELDS)
    ids = reduce(
        DataFrame.unionByName,
        [
            getattr(book, table).select(
                F.lit(field).alias("field"), F.col(KEY[table]).cast("string").alias("subject_id")
            )
            for field, (table, _, _) in AMOUNT_FIELDS.items()
        ],
    )
    # Keep only the asked ids before anything else: the batch is the small side.
    found = _asked(ids, changes, "field").withColumn("found", F.lit(True))
    messages = F.create_map(*[F.lit(x) for f, v in AMOUNT_FIELDS.items() for x in (f, v[2])])
    amount = F.col("new_amount").cast("string")
    safe = (
        F.coalesce(F.col("subject_id").cast("string").rlike(SAFE_ID), F.lit(False))
        & F.coalesce(F.col("field").isin(known_fields), F.lit(False))
        & F.coalesce(amount.rlike(r"^[+-]?\d+$"), F.lit(False))
    )
    judged = (
        changes.withColumn("subject_id", F.col("subject_id").cast("string"))
        .join(found, ["field", "subject_id"], "left")
        .withColumn(
            "reason",
            F.when(~safe, BAD_UPDATE)
            .when(F.col("found").isNull(), NOT_FOUND)
            .when(amount.try_cast("decimal(20,2)").isNull(), BAD_UPDATE)
            .when(amount.try_cast("decimal(20,2)") <= 0, F.try_element_at(messages, F.col("field")))
            .otherwise("updated"),
        )
        .withColumn("accepted", F.col("reason") == "updated")
    )
    judged = stage(judged, "judged")
    tables = {}
    for field, (table, column, _) in AMOUNT_FIELDS.items():
        stored = getattr(book, table)
        kind = stored.schema[column].dataType
        latest = (
            judged.filter((F.col("field") == field) & F.col("accepted"))
            .groupBy(F.col("subject_id").try_cast(stored.schema[KEY[table]].dataType).alias(KEY[table]))
            .agg(F.max_by(F.col("new_amount").cast("string"), "change_id").try_cast(kind).alias("_new"))
        )
        tables[table] = (
            stored.join(latest, KEY[table], "left")
            .withColumn(column, F.coalesce("_new", column))
            .select(*stored.columns)
        )
    outcome = judged.select("change_id", "subject_id", "field", "accepted", "reason")
    return book.with_tables(**tables), outcome


# --- soft deletes -----------------------------------------------------------


def referenced_entities(book: Book) -> DataFrame:
    """``entity_id`` of borrowers, lenders and guarantors of active records, each once."""
    loans = book.active_loans
    return reduce(
        DataFrame.unionByName,
        [
            loans.select(F.col("borrower_entity_id").alias("entity_id")),
            loans.select(F.col("lender_entity_id").alias("entity_id")),
            book.active_guarantees.select(F.col("guarantor_entity_id").alias("entity_id")),
        ],
    ).distinct()


def _asked(ids: DataFrame, batch: DataFrame, label: str) -> DataFrame:
    """Distinct ``subject_id`` and ``label`` pairs of ``ids`` that the batch names."""
    wanted = batch.select(F.col("subject_id").cast("string").alias("subject_id"), label).distinct()
    return ids.join(wanted, ["subject_id", label], "left_semi").distinct()


def apply_deactivations(book: Book, requests: DataFrame) -> tuple[Book, DataFrame]:
    """Soft-delete records: ``subject_id, kind``; rows stay, status changes.

    Returns the new book and ``subject_id, kind, accepted, reason``. Loans close,
    other records become inactive; an entity behind active records is refused.
    """
    ids = reduce(
        DataFrame.unionByName,
        [
            getattr(book, table)
            .select(F.col(KEY[table]).cast("string").alias("subject_id"))
            .withColumn("kind", F.lit(kind))
            for kind, table in KINDS.items()
        ],
    )
    found = _asked(ids, requests, "kind").withColumn("found", F.lit(True))
    references = referenced_entities(book).select(
        F.col("entity_id").cast("string").alias("subject_id"), F.lit("entity").alias("kind")
    )
    in_use = _asked(references, requests, "kind").withColumn("in_use", F.lit(True))
    new_status = F.when(F.col("kind") == "loan", "closed").otherwise("inactive")
    done = F.concat(F.lit(SWITCHED_OFF[0]), new_status, F.lit(SWITCHED_OFF[1]))
    judged = (
        requests.withColumn("subject_id", F.col("subject_id").cast("string"))
        .join(found, ["subject_id", "kind"], "left")
        .join(in_use, ["subject_id", "kind"], "left")
        .withColumn(
            "accepted",
            F.coalesce(F.col("subject_id").rlike(SAFE_ID), F.lit(False))
            & F.col("found").isNotNull()
            & F.col("in_use").isNull(),
        )
        .withColumn(
            "reason",
            F.when(~F.coalesce(F.col("subject_id").rlike(SAFE_ID), F.lit(False)), BAD_ID)
            .when(F.col("found").isNull(), NOT_FOUND)
            .when(F.col("in_use").isNotNull(), STILL_REFERENCED)
            .otherwise(done),
        )
    )
    judged = stage(judged, "judged")
    tables = {}
    for kind, table in KINDS.items():
        stored = getattr(book, table)
        hit = (
            judged.filter((F.col("kind") == kind) & F.col("accepted"))
            .select(F.col("subject_id").try_cast(stored.schema[KEY[table]].dataType).alias(KEY[table]))
            .distinct()
            .withColumn("_off", F.lit("closed" if kind == "loan" else "inactive"))
        )
        tables[table] = (
            stored.join(hit, KEY[table], "left")
            .withColumn("status", F.coalesce("_off", "status"))
            .select(*stored.columns)
        )
    new = book.with_tables(**tables)
    new.share_ownership(book)  # a status change moves no owner
    return new, judged.select("subject_id", "kind", "accepted", "reason")


# --- flags ------------------------------------------------------------------


def _changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that only one side has, or that differ in any column; none for one and the same table."""
    if before is after:
        return before.select(*key).limit(0)

    def packed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*key, F.struct(*df.columns).alias("row"))
        return rows.groupBy(*key).agg(F.sort_array(F.collect_list("row")).alias(name))

    # Keys are ids, so a group holds the few rows that repeat one.
    same = F.col("old").eqNullSafe(F.col("new"))
    return packed(before, "old").join(packed(after.select(*before.columns), "new"), key, "full_outer").filter(~same).select(*key)


def affected(before: Book, after: Book) -> tuple[DataFrame, DataFrame] | None:
    """``head`` whose connected exposure or limit a change can move, and ``loan_id`` whose wrong-way risk it can.

    A changed loan, guarantee or collateral row moves its borrower's and guarantors' owners, and those
    of every borrower behind the same items; a limit moves its own entity. None if owners changed:
    then everything can move.
    """
    if not _changed(before.entities, after.entities, ["entity_id"]).isEmpty():
        return None
    loans = stage(_changed(before.loans, after.loans, ["loan_id"]), "changed-loans")
    key = ["collateral_id", "securing_loan_id"]
    pairs = stage(_changed(before.collateral, after.collateral, key), "changed-pairs")
    given = _changed(before.guarantees, after.guarantees, ["guarantee_id"])
    limits = _changed(before.limits, after.limits, ["limit_id"])

    def both(table: str, *columns: str) -> DataFrame:
        old, new = getattr(before, table), getattr(after, table)
        rows = old.select(*columns)
        return rows if old is new else rows.union(new.select(*columns))

    held = both("collateral", "collateral_id", "securing_loan_id")
    items = pairs.select("collateral_id").union(
        held.join(loans.withColumnRenamed("loan_id", "securing_loan_id"), "securing_loan_id", "left_semi").select("collateral_id")
    )
    beside = held.join(items.distinct(), "collateral_id", "left_semi").select(F.col("securing_loan_id").alias("loan_id"))
    touched = stage(loans.union(beside).distinct(), "touched-loans")
    borrowers = both("loans", "loan_id", "borrower_entity_id").join(touched, "loan_id", "left_semi").select("borrower_entity_id")
    edges = both("guarantees", "guarantee_id", "guarantor_entity_id", "beneficiary_loan_id")
    on_loans = edges.join(loans.withColumnRenamed("loan_id", "beneficiary_loan_id"), "beneficiary_loan_id", "left_semi")
    guarantors = on_loans.union(edges.join(given, "guarantee_id", "left_semi").select(*on_loans.columns)).select("guarantor_entity_id")
    moved = stage(borrowers.union(guarantors).distinct().toDF("member"), "moved")
    heads = closure(before).join(moved, "member", "left_semi").select("head").union(moved)
    own = both("limits", "limit_id", "entity_id").join(limits, "limit_id", "left_semi").select("entity_id")
    wrong_way = loans.union(pairs.select("securing_loan_id")).distinct()
    return stage(heads.union(own).distinct(), "affected"), wrong_way


def change_flags(before: Book, after: Book) -> DataFrame:
    """``flag, subject``: limit breaches and wrong-way loans the change brought.

    Both sides are computed for what the changed rows can affect, and for that alone.
    """
    moved = affected(before, after)
    heads, loans = moved if moved is not None else (None, None)
    if heads is not None:  # only names with a limit can breach it
        limited = before.limits.select("entity_id").union(after.limits.select("entity_id")).distinct()
        heads = stage(heads.join(limited.withColumnRenamed("entity_id", "head"), "head", "left_semi"), "affected")

    def flags(book: Book) -> DataFrame:
        breaches = limit_breaches(book, heads).select(
            F.lit("limit-breach").alias("flag"), F.col("entity_id").cast("string").alias("subject")
        )
        wrong_way = structural_wwr(book, loans).select(
            F.lit("wrong-way-risk").alias("flag"), F.col("loan_id").cast("string").alias("subject")
        )
        return breaches.unionByName(wrong_way).distinct()

    return flags(after).join(flags(before), ["flag", "subject"], "left_anti")


def flag_records(book: Book, actor: str = "anonymous", role: str = "group_risk") -> DataFrame:
    """One audit-shaped row per current breach and wrong-way loan."""
    breaches = limit_breaches(book).select(
        F.lit("flag-limit-breach").alias("action"),
        F.col("entity_id").cast("string").alias("target"),
        F.format_string(
            BREACH_REASON,
            F.col("connected").cast("string"),
            F.col("limit_amount").cast("string"),
        ).alias("reason"),
        F.create_map(
            F.lit("connected"),
            F.col("connected").cast("string"),
            F.lit("limit"),
            F.col("limit_amount").cast("string"),
        ).alias("payload"),
        F.array(F.lit("limit-breach")).alias("flags"),
    )
    wrong_way = structural_wwr(book).select(
        F.lit("flag-wrong-way-risk").alias("action"),
        F.col("loan_id").cast("string").alias("target"),
        F.format_string(
            WRONG_WAY_REASON,
            F.col("collateral").cast("string"),
            F.col("group").cast("string"),
        ).alias("reason"),
        F.create_map(
            F.lit("issuer"),
            F.col("issuer").cast("string"),
            F.lit("group"),
            F.col("group").cast("string"),
        ).alias("payload"),
        F.array(F.lit("wrong-way-risk")).alias("flags"),
    )
    return breaches.unionByName(wrong_way).select(
        "action",
        "target",
        F.lit(actor).alias("actor"),
        F.lit(role).alias("role"),
        F.lit("accepted").alias("outcome"),
        "reason",
        "payload",
        "flags",
    )


# --- approvals --------------------------------------------------------------


def resolve_approvals(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Four-eyes decisions: ``id, kind, subject_id, checker, decision, accepted, reason``.

    ``pending`` is ``id, kind, subject_id, maker, maker_role, status``; ``decisions``
    is ``id, checker, checker_role, decision`` (approve or reject). Approved ids go
    on to :func:`apply_deactivations`.
    """
    joined = decisions.join(
        pending.select("id", "kind", "subject_id", "maker", "status"), "id", "left"
    )
    denial = (
        F.when(
            ~F.coalesce(F.col("status") == "pending", F.lit(False)), F.lit(NOT_PENDING)
        )
        .when(
            F.col("checker") == F.col("maker"),
            F.lit(SAME_PERSON),
        )
        .when(
            ~F.coalesce(F.col("checker_role").isin(*CHECKER_ROLES), F.lit(False)),
            F.format_string(
                "role '%s' may not approve changes", F.coalesce("checker_role", F.lit(""))
            ),
        )
    )
    outcome = F.when(F.col("decision") == "reject", "rejected by checker").otherwise("approved")
    return joined.select(
        "id",
        "kind",
        F.coalesce(F.col("subject_id").cast("string"), F.col("id").cast("string")).alias(
            "subject_id"
        ),
        "checker",
        "decision",
        denial.isNull().alias("accepted"),
        F.coalesce(denial, outcome).alias("reason"),
    )


def approved_deactivations(resolved: DataFrame) -> DataFrame:
    """``subject_id, kind`` of accepted approvals."""
    return resolved.filter(F.col("accepted") & (F.col("decision") == "approve")).select(
        "subject_id", "kind"
    )
