"""Record validation: every rule a record breaks, per table, and the import report.

Rules are Boolean columns over the text rows. A record is a key; its rows are
reduced with ``bool_or``, so a key repeated a million times is still one small
aggregate, and values that must be single are compared by min and max.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkbook.plans.staging import stage
from linkbook.schema import COUNTERPARTY_TYPES, KEY, LOAN_STATUSES, TABLES

# Messages shown for broken rules.
MISSING_ID = "missing id"
UNFIT = "amounts are stored in whole cents with at most 18 digits before the point"
BLANK_ID = "(blank)"
TYPE = "counterpartyType must be one of bank/corporate/nbfi/government."
SECTOR = "Every legal entity needs a sector."
BORROWER = "A loan must reference an existing borrower legal entity."
LENDER = "A loan must reference an existing lender legal entity."
PRINCIPAL = "principalAmount must be a positive decimal."
STATUS = "status must be active or closed."
GUARANTOR = "A guaranty must reference an existing guarantor legal entity."
GUARANTEED_LOAN = "A guaranty must reference an existing loan."
GUARANTEED_AMOUNT = "guaranteedAmount must be a positive decimal."
TWO_PARTIES = (
    "Guarantor must differ from the guaranteed loan's borrower (two distinct entities)."
)
PLEDGER = "Collateral must be pledged by an existing legal entity."
SECURED_LOAN = "Collateral must secure at least one existing loan."
ISSUER = "collateralIssuer, if present, must be an existing legal entity."
VALUE = "collateralValue, if present, must be a positive decimal."
HAIRCUT = "haircut, if present, must be a fraction between 0 and 1."
LIMIT_AMOUNT = "limitAmount must be a positive decimal."
LIMIT_ENTITY = "A limit must reference an existing legal entity."


@dataclass(frozen=True)
class Rule:
    """A message, the row condition that breaks it, and text that must agree across rows."""

    message: str
    broken: Column
    single: Column | None = None


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _is_decimal(name: str) -> Column:
    return _text(name).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")


def _number(name: str) -> Column:
    return F.when(_is_decimal(name), F.col(name).try_cast("decimal(38,10)"))


def _not_positive(name: str) -> Column:
    return ~F.coalesce(_number(name) > 0, F.lit(False))


def _unfit(name: str) -> Column:
    """A number that the stored amount would lose or alter: too long, or finer than a cent."""
    stored = F.when(_is_decimal(name), F.col(name).try_cast("decimal(20,2)"))
    exact = F.coalesce(_number(name) == stored.cast("decimal(38,10)"), F.lit(False))
    return _is_decimal(name) & ~exact


def _same_number(name: str) -> Column:
    """Text to compare: the number where it is one, so 5 and 5.00 agree."""
    return F.coalesce(_number(name).cast("string"), _text(name))


def record_id(table: str) -> Column:
    return F.trim(_text(KEY[table]))


# Cells that have to name an entity or a loan.
ENTITY_CELLS = (
    ("loans", "borrower_entity_id"),
    ("loans", "lender_entity_id"),
    ("guarantees", "guarantor_entity_id"),
    ("collateral", "pledged_by_entity_id"),
    ("collateral", "issuer_entity_id"),
    ("limits", "entity_id"),
)
LOAN_CELLS = (("guarantees", "beneficiary_loan_id"), ("collateral", "securing_loan_id"))


def references(raw: Mapping[str, DataFrame], ids: bool = False) -> DataFrame:
    """``kind, value, is_id``: what cells of ``raw`` name, and with ``ids`` its entities and loans; one scan a table."""
    cells = [(t, "entity", c, False) for t, c in ENTITY_CELLS] + [(t, "loan", c, False) for t, c in LOAN_CELLS]
    if ids:
        cells += [("entities", "entity", KEY["entities"], True), ("loans", "loan", KEY["loans"], True)]
    parts = []
    for table in dict.fromkeys(t for t, *_ in cells):
        named = [
            F.struct(F.lit(kind).alias("kind"), _text(column).alias("value"), F.lit(is_id).alias("is_id"))
            for t, kind, column, is_id in cells
            if t == table
        ]
        parts.append(raw[table].select(F.inline(F.array(*named))))
    return reduce(DataFrame.unionByName, parts).filter(~(F.col("is_id") & (F.trim("value") == "")))


def unknown_references(raw: Mapping[str, DataFrame]) -> DataFrame:
    """``kind, value``: what cells of ``raw`` name, and none of its entities or loans is.

    All references and all ids are one tagged table, grouped once; equal values meet before the
    exchange, so one that most rows share travels once a task.
    """
    grouped = references(raw, ids=True).groupBy("kind", "value").agg(F.bool_or("is_id").alias("known"))
    return grouped.filter(~F.col("known")).select("kind", "value")


def _look_up(rows: DataFrame, column: str, unknown: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``{column}_unknown`` where the text in ``column`` is no id; few are, in a sound source."""
    found = unknown.filter(F.col("kind") == kind).select(F.col("value").alias(column), F.lit(True).alias(f"{column}_unknown"))
    return rows.join(found, column, "left")


def _missing(column: str) -> Column:
    return F.col(f"{column}_unknown").isNotNull()


def _entities(raw: Mapping[str, DataFrame], strict: bool) -> tuple[DataFrame, list[Rule]]:
    rules = [
        Rule(
            TYPE,
            ~_text("counterparty_type").isin(*COUNTERPARTY_TYPES),
            _text("counterparty_type"),
        )
    ]
    if strict:
        rules.append(Rule(SECTOR, _text("sector") == ""))
    return raw["entities"], rules


def _loans(raw: Mapping[str, DataFrame], unknown: DataFrame) -> tuple[DataFrame, list[Rule]]:
    rows = raw["loans"].withColumns(
        {"_b": _text("borrower_entity_id"), "_l": _text("lender_entity_id")}
    )
    for column in ("_b", "_l"):
        rows = _look_up(rows, column, unknown, "entity")
    return rows, [
        Rule(BORROWER, _missing("_b"), F.col("_b")),
        Rule(LENDER, _missing("_l"), F.col("_l")),
        Rule(PRINCIPAL, _not_positive("exposure_amount"), _same_number("exposure_amount")),
        Rule(UNFIT, ~_not_positive("exposure_amount") & _unfit("exposure_amount")),
        Rule(STATUS, ~_text("status").isin(*LOAN_STATUSES), _text("status")),
    ]


def _guarantees(
    raw: Mapping[str, DataFrame], unknown: DataFrame, loan_ids: DataFrame
) -> tuple[DataFrame, list[Rule]]:
    borrowers = loan_ids.select(
        _text("loan_id").alias("_loan"),
        _text("borrower_entity_id").alias("_g"),
        F.lit(True).alias("_self"),
    ).distinct()
    rows = (
        raw["guarantees"]
        .withColumn("_g", _text("guarantor_entity_id"))
        .withColumn("_loan", _text("beneficiary_loan_id"))
        .join(borrowers, ["_loan", "_g"], "left")
    )
    rows = _look_up(_look_up(rows, "_g", unknown, "entity"), "_loan", unknown, "loan")
    return rows, [
        Rule(GUARANTOR, _missing("_g"), F.col("_g")),
        Rule(GUARANTEED_LOAN, _missing("_loan"), F.col("_loan")),
        Rule(GUARANTEED_AMOUNT, _not_positive("amount"), _same_number("amount")),
        Rule(UNFIT, ~_not_positive("amount") & _unfit("amount")),
        Rule(TWO_PARTIES, F.col("_self").isNotNull()),
    ]


def _collateral(raw: Mapping[str, DataFrame], unknown: DataFrame) -> tuple[DataFrame, list[Rule]]:
    rows = (
        raw["collateral"]
        .withColumn("_p", _text("pledged_by_entity_id"))
        .withColumn("_i", _text("issuer_entity_id"))
        .withColumn("_loan", _text("securing_loan_id"))
    )
    for column, kind in (("_p", "entity"), ("_i", "entity"), ("_loan", "loan")):
        rows = _look_up(rows, column, unknown, kind)
    valued = _text("collateral_value") != ""
    percent = F.when(_text("haircut_pct") == "", F.lit(0)).when(
        _text("haircut_pct").rlike(r"^[+-]?\d+$"), F.col("haircut_pct").try_cast("int")
    )
    return rows, [
        Rule(PLEDGER, _missing("_p")),
        Rule(SECURED_LOAN, _missing("_loan")),
        Rule(ISSUER, (F.col("_i") != "") & _missing("_i")),
        Rule(
            VALUE,
            valued & _not_positive("collateral_value"),
            F.when(valued, _same_number("collateral_value")),
        ),
        Rule(UNFIT, valued & ~_not_positive("collateral_value") & _unfit("collateral_value")),
        Rule(
            HAIRCUT,
            valued & ~F.coalesce(percent.between(0, 100), F.lit(False)),
            F.when(valued, F.coalesce(percent.cast("string"), _text("haircut_pct"))),
        ),
    ]


def _limits(
    raw: Mapping[str, DataFrame], unknown: DataFrame, strict: bool
) -> tuple[DataFrame, list[Rule]]:
    rules = [
        Rule(LIMIT_AMOUNT, _not_positive("single_name_limit"), _same_number("single_name_limit")),
        Rule(UNFIT, ~_not_positive("single_name_limit") & _unfit("single_name_limit")),
    ]
    rows = raw["limits"]
    if strict:
        rows = _look_up(rows.withColumn("_e", _text("entity_id")), "_e", unknown, "entity")
        rules.append(Rule(LIMIT_ENTITY, _missing("_e")))
    return rows, rules


def _reduce(rows: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per record id with its sorted distinct messages."""
    checks = []
    for i, rule in enumerate(rules):
        checks.append(F.bool_or(F.coalesce(rule.broken, F.lit(True))).alias(f"b{i}"))
        if rule.single is not None:
            checks.append(
                F.coalesce(F.min(rule.single) != F.max(rule.single), F.lit(False)).alias(f"s{i}")
            )
    messages = [
        F.when(
            F.col(f"b{i}") | (F.col(f"s{i}") if rule.single is not None else F.lit(False)),
            F.lit(rule.message),
        )
        for i, rule in enumerate(rules)
    ]
    return (
        rows.withColumn("record_id", record_id(table))
        .filter(F.col("record_id") != "")
        .groupBy("record_id")
        .agg(*checks)
        .select(
            F.lit(table).alias("table"),
            "record_id",
            F.array_sort(F.array_distinct(F.array_compact(F.array(*messages)))).alias("reasons"),
        )
    )


def keyed_records(
    raw: Mapping[str, DataFrame],
    strict: bool = True,
    loan_ids: DataFrame | None = None,
    unknown: DataFrame | None = None,
) -> DataFrame:
    """``table, record_id, accepted, reasons`` of every record that has a key.

    References are looked up among all candidates, rejected ones included. When the candidates are
    only part of the data, ``unknown`` has the references that nothing answers (``kind, value``) and
    ``loan_ids`` the loans they name. ``strict`` adds two documented rules: a non-blank sector and an
    existing entity behind every limit.
    """
    # Written first: where few references are unknown, no table is shuffled to look them up.
    unknown = stage(unknown_references(raw) if unknown is None else unknown, "unknown")
    loan_ids = (raw["loans"] if loan_ids is None else loan_ids).filter(record_id("loans") != "")
    checked = [
        ("entities", *_entities(raw, strict)),
        ("loans", *_loans(raw, unknown)),
        ("guarantees", *_guarantees(raw, unknown, loan_ids)),
        ("collateral", *_collateral(raw, unknown)),
        ("limits", *_limits(raw, unknown, strict)),
    ]
    return reduce(
        DataFrame.unionByName, [_reduce(rows, table, rules) for table, rows, rules in checked]
    ).select("table", "record_id", (F.size("reasons") == 0).alias("accepted"), "reasons")


def blank_records(raw: Mapping[str, DataFrame]) -> DataFrame:
    """One rejected record per row without a key."""
    return reduce(
        DataFrame.unionByName,
        [
            raw[t]
            .filter(record_id(t) == "")
            .select(
                F.lit(t).alias("table"),
                F.lit(BLANK_ID).alias("record_id"),
                F.lit(False).alias("accepted"),
                F.array(F.lit(MISSING_ID)).alias("reasons"),
            )
            for t in TABLES
        ],
    )


def check_records(raw: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """Every record of the candidate tables with its verdict and reasons."""
    return keyed_records(raw, strict).unionByName(blank_records(raw))


def report_totals(report: DataFrame) -> DataFrame:
    """One row: ``accepted, rejected, total``."""
    return report.agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count("*").alias("total"),
    )


def rejections_by_reason(report: DataFrame) -> DataFrame:
    """``table, reason, records``."""
    return (
        report.filter(~F.col("accepted"))
        .select("table", F.explode("reasons").alias("reason"))
        .groupBy("table", "reason")
        .agg(F.count("*").alias("records"))
    )


def duplicate_keys(raw: Mapping[str, DataFrame]) -> DataFrame:
    """``table, record_id, rows`` of keys whose rows disagree in any column but the pair link."""
    out = []
    for table in TABLES:
        df = raw[table]
        # One collateral item has a row per loan it secures; only its attributes must agree.
        values = [c for c in df.columns if c not in (KEY[table], "securing_loan_id")]
        content = F.struct(*[_text(c).alias(c) for c in values])
        out.append(
            df.withColumn("record_id", record_id(table))
            .filter(F.col("record_id") != "")
            .groupBy("record_id")
            .agg(
                F.count("*").alias("rows"),
                F.min(content).alias("least"),
                F.max(content).alias("most"),
            )
            .filter(F.col("least") != F.col("most"))
            .select(F.lit(table).alias("table"), "record_id", "rows")
        )
    return reduce(DataFrame.unionByName, out)


def accepted_rows(raw: Mapping[str, DataFrame], report: DataFrame) -> dict[str, DataFrame]:
    """Rows of accepted records, still as text."""
    good = report.filter("accepted")
    return {
        t: raw[t]
        .withColumn("record_id", record_id(t))
        .join(
            good.filter(F.col("table") == t).select("record_id"), "record_id", "left_semi"
        )
        .drop("record_id")
        for t in TABLES
    }
