"""Canonical tables: columns, Spark types, required columns, enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)
SUM_MONEY = T.DecimalType(30, 2)

# Canonical columns per table and their types.
COLUMNS: dict[str, dict[str, T.DataType]] = {
    "entities": {
        "entity_id": T.StringType(),
        "entity_name": T.StringType(),
        "counterparty_type": T.StringType(),
        "sector": T.StringType(),
        "parent_entity_id": T.StringType(),
        "eligible_capital": MONEY,
        "annual_revenue": MONEY,
        "country": T.StringType(),
        "rating": T.StringType(),
    },
    "loans": {
        "loan_id": T.StringType(),
        "lender_entity_id": T.StringType(),
        "borrower_entity_id": T.StringType(),
        "exposure_amount": MONEY,
        "currency": T.StringType(),
        "status": T.StringType(),
        "maturity_years": T.IntegerType(),
    },
    "guarantees": {
        "guarantee_id": T.StringType(),
        "guarantor_entity_id": T.StringType(),
        "beneficiary_loan_id": T.StringType(),
        "amount": MONEY,
        "currency": T.StringType(),
    },
    "collateral": {
        "collateral_id": T.StringType(),
        "collateral_type": T.StringType(),
        "pledged_by_entity_id": T.StringType(),
        "securing_loan_id": T.StringType(),
        "issuer_entity_id": T.StringType(),
        "collateral_value": MONEY,
        "haircut_pct": T.IntegerType(),
    },
    "limits": {
        "limit_id": T.StringType(),
        "entity_id": T.StringType(),
        "single_name_limit": MONEY,
        "currency": T.StringType(),
    },
}

REQUIRED: dict[str, list[str]] = {
    "entities": ["entity_id", "entity_name", "counterparty_type", "sector"],
    "loans": [
        "loan_id",
        "lender_entity_id",
        "borrower_entity_id",
        "exposure_amount",
        "currency",
        "status",
    ],
    "guarantees": list(COLUMNS["guarantees"]),
    "collateral": ["collateral_id", "collateral_type", "pledged_by_entity_id", "securing_loan_id"],
    "limits": list(COLUMNS["limits"]),
}

KEY = {
    "entities": "entity_id",
    "loans": "loan_id",
    "guarantees": "guarantee_id",
    "collateral": "collateral_id",
    "limits": "limit_id",
}

TABLES = tuple(COLUMNS)
MANDATORY_TABLES = ("entities", "loans")
COUNTERPARTY_TYPES = ("bank", "corporate", "nbfi", "government")
LOAN_STATUSES = ("active", "closed")

DEFAULT_MATURITY = 3
DEFAULT_HAIRCUT = 0
DEFAULT_STATUS = "active"


def raw_schema(table: str) -> T.StructType:
    """Every column as text, the way a source file is first read."""
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[table]])


def typed_schema(table: str) -> T.StructType:
    """Typed columns plus the ``status`` every table carries once loaded."""
    fields = [T.StructField(c, t) for c, t in COLUMNS[table].items()]
    if "status" not in COLUMNS[table]:
        fields.append(T.StructField("status", T.StringType()))
    return T.StructType(fields)
