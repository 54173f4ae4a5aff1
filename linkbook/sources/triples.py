"""Book tables as subject-predicate-object rows and as N-Triples text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkbook.book import Book

# Public vocabulary terms.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DCT_SOURCE = "http://purl.org/dc/terms/source"
XSD_DECIMAL = "http://www.w3.org/2001/XMLSchema#decimal"
LEGAL_ENTITY = "https://www.omg.org/spec/Commons/Organizations/LegalEntity"
FIBO = "https://spec.edmcouncil.org/fibo/ontology/"
LOAN = FIBO + "LOAN/LoansGeneral/Loans/Loan"
COLLATERAL = FIBO + "FBC/DebtAndEquities/Debt/Collateral"
GUARANTY = FIBO + "FBC/DebtAndEquities/Guaranty/Guaranty"


@dataclass(frozen=True)
class Namespaces:
    """Bases of the application terms and of the record ids; set them to your store's own."""

    terms: str = "https://example.org/credit/terms/"
    ids: str = "https://example.org/credit/id/"


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return _trim_zeros(F.col(name))
    return F.col(name).cast("string")


def _trim_zeros(column: Column) -> Column:
    # Two-step: drop zeros after the point, then a bare point.
    text = F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(text, r"\.$", "")


class _Facts:
    """Collects (predicate, object, kind) cells of one table."""

    def __init__(self, df: DataFrame, subject: str, ns: Namespaces) -> None:
        self.df, self.subject, self.ns = df, subject, ns
        self.cells: list[Column] = []

    def _add(self, predicate: str, value: Column, kind: str) -> _Facts:
        self.cells.append(
            F.struct(F.lit(predicate).alias("p"), value.alias("o"), F.lit(kind).alias("kind"))
        )
        return self

    def iri(self, predicate: str, value: str) -> _Facts:
        return self._add(predicate, F.lit(value), "iri")

    def link(self, term: str, column: str) -> _Facts:
        value = F.concat(F.lit(self.ns.ids), F.nullif(F.col(column).cast("string"), F.lit("")))
        return self._add(self.ns.terms + term, value, "iri")

    def text(self, predicate: str, value: Column) -> _Facts:
        return self._add(predicate, value.cast("string"), "string")

    def term(self, term: str, column: str, optional: bool = False) -> _Facts:
        value = F.col(column).cast("string")
        value = F.nullif(value, F.lit("")) if optional else F.coalesce(value, F.lit(""))
        return self._add(self.ns.terms + term, value, "string")

    def number(self, term: str, column: str) -> _Facts:
        return self._add(self.ns.terms + term, _number(self.df, column), "decimal")

    def value(self, term: str, value: Column) -> _Facts:
        return self._add(self.ns.terms + term, value, "decimal")

    def rows(self) -> DataFrame:
        subject = F.concat(F.lit(self.ns.ids), F.col(self.subject).cast("string")).alias("s")
        return self.df.select(subject, F.inline(F.array(*self.cells))).filter(
            F.col("o").isNotNull()
        )


def _label(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + " "), F.col(column).cast("string"))


def triples(book: Book, ns: Namespaces = Namespaces()) -> DataFrame:
    """``s, p, o, kind`` rows; kind is ``iri``, ``string`` or ``decimal``.

    Item attributes come from the item table and only the loan links from the
    (item, loan) pairs, so repeated collateral rows add nothing to dedupe.
    """
    entities = (
        _Facts(book.entities, "entity_id", ns)
        .iri(RDF_TYPE, LEGAL_ENTITY)
        .text(RDFS_LABEL, F.coalesce("entity_name", F.lit("")))
        .term("sector", "sector")
        .term("counterpartyType", "counterparty_type")
        .term("status", "status")
        .text(DCT_SOURCE, F.lit("entities.csv"))
        .link("isSubsidiaryOf", "parent_entity_id")
        .number("eligibleCapital", "eligible_capital")
        .number("annualRevenue", "annual_revenue")
        .term("country", "country", optional=True)
        .term("rating", "rating", optional=True)
    )
    loans = (
        _Facts(book.loans, "loan_id", ns)
        .iri(RDF_TYPE, LOAN)
        .text(RDFS_LABEL, _label("Loan", "loan_id"))
        .link("lender", "lender_entity_id")
        .link("borrower", "borrower_entity_id")
        .number("principalAmount", "exposure_amount")
        .term("currency", "currency")
        .term("status", "status")
        .number("maturityYears", "maturity_years")
        .text(DCT_SOURCE, F.lit("loans.csv"))
    )
    guarantees = (
        _Facts(book.guarantees, "guarantee_id", ns)
        .iri(RDF_TYPE, GUARANTY)
        .text(RDFS_LABEL, _label("Guaranty", "guarantee_id"))
        .link("guarantor", "guarantor_entity_id")
        .link("guaranteedLoan", "beneficiary_loan_id")
        .number("guaranteedAmount", "amount")
        .term("currency", "currency")
        .term("status", "status")
        .text(DCT_SOURCE, F.lit("guarantees.csv"))
    )
    haircut = F.when(
        F.col("collateral_value").isNotNull(),
        _trim_zeros(
            (F.coalesce("haircut_pct", F.lit(0)).cast("decimal(3,0)") * F.lit(0.01).cast("decimal(3,2)"))
        ),
    )
    items = (
        _Facts(book.items, "collateral_id", ns)
        .iri(RDF_TYPE, COLLATERAL)
        .text(RDFS_LABEL, F.col("collateral_type"))
        .link("pledgedBy", "pledged_by_entity_id")
        .link("collateralIssuer", "issuer_entity_id")
        .number("collateralValue", "collateral_value")
        .value("haircut", haircut)
        .term("status", "status")
        .text(DCT_SOURCE, F.lit("collateral.csv"))
    )
    secured = _Facts(
        book.collateral.select("collateral_id", "securing_loan_id"), "collateral_id", ns
    ).link("securesLoan", "securing_loan_id")
    limits = (
        _Facts(book.limits, "limit_id", ns)
        .iri(RDF_TYPE, ns.terms + "Limit")
        .text(RDFS_LABEL, _label("Limit", "limit_id"))
        .number("limitAmount", "single_name_limit")
        .term("currency", "currency")
        .term("status", "status")
        .text(DCT_SOURCE, F.lit("limits.csv"))
    )
    holders = _Facts(book.limits.select("entity_id", "limit_id"), "entity_id", ns).link(
        "hasLimit", "limit_id"
    )
    tables = [entities, loans, guarantees, items, secured, limits, holders]
    return reduce(DataFrame.unionByName, [t.rows() for t in tables])


def distinct_triples(rows: DataFrame) -> DataFrame:
    """The set of triples. Skip it when every table's key is already unique."""
    return rows.dropDuplicates(["s", "p", "o", "kind"])


def ntriples_line(s: str = "s", p: str = "p", o: str = "o", kind: str = "kind") -> Column:
    """One N-Triples line; string literals are escaped by the W3C rules."""
    text = F.col(o)
    for found, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(found), F.lit(escaped))
    thing = (
        F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.col(o), F.lit(">")))
        .when(
            F.col(kind) == "decimal",
            F.concat(F.lit('"'), F.col(o), F.lit(f'"^^<{XSD_DECIMAL}>')),
        )
        .otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    )
    return F.concat(
        F.lit("<"), F.col(s), F.lit("> <"), F.col(p), F.lit("> "), thing, F.lit(" .")
    )


def write_ntriples(rows: DataFrame, path: str, dedupe: bool = True) -> None:
    """Write N-Triples text, one file per partition."""
    unique = distinct_triples(rows) if dedupe else rows
    unique.select(ntriples_line().alias("value")).write.mode("overwrite").text(path)


def triple_counts(rows: DataFrame) -> DataFrame:
    """``p, triples`` over the distinct triples."""
    return distinct_triples(rows).groupBy("p").agg(F.count("*").alias("triples"))
