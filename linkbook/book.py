"""The lending book: five DataFrames and the views most operators start from."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook.operators.labels import Labels, labelled, listing, owners
from linkbook.operators.ownership import ownership
from linkbook.plans.staging import stage
from linkbook.schema import TABLES

ITEM_ATTRIBUTES = (
    "collateral_type",
    "pledged_by_entity_id",
    "issuer_entity_id",
    "collateral_value",
    "haircut_pct",
    "status",
)


@dataclass(frozen=True)
class Book:
    """One dataset. ``collateral`` keeps one row per (item, loan)."""

    entities: DataFrame
    loans: DataFrame
    guarantees: DataFrame
    collateral: DataFrame
    limits: DataFrame

    def with_tables(self, **tables: DataFrame) -> Book:
        """A new book with some tables replaced; ownership is kept if entities are."""
        new = replace(self, **tables)
        if "entities" not in tables:
            new.share_ownership(self)
        return new

    def share_ownership(self, other: Book) -> None:
        """Take over what is known of the owners of a book with the same entities."""
        for known in ("_paths", "labels", "ownership", "owner_pairs"):
            if known in other.__dict__:
                self.__dict__[known] = other.__dict__[known]

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    @cached_property
    def _paths(self) -> DataFrame | None:
        return ownership(self.entities)

    @property
    def deep(self) -> bool:
        """Whether chains of owners are too long to hold paths."""
        return self._paths is None

    @cached_property
    def ownership(self) -> DataFrame:
        """``entity_id, path, ubo, cyclic``, without ``path`` if the book is deep: walked once per book, then re-read."""
        return owners(self.labels) if self._paths is None else self._paths

    @cached_property
    def labels(self) -> Labels:
        """Ranges of the groups, computed once per book."""
        return labelled(self.entities)

    @cached_property
    def owner_pairs(self) -> DataFrame:
        """``member, head, depth`` of a deep book, for results that list such pairs."""
        return stage(listing(self.labels), "owner-pairs")

    @property
    def active_loans(self) -> DataFrame:
        return self.loans.filter(F.col("status") == "active")

    @property
    def active_guarantees(self) -> DataFrame:
        return self.guarantees.filter(F.col("status") == "active")

    @property
    def active_collateral(self) -> DataFrame:
        return self.collateral.filter(F.col("status") == "active")

    @property
    def active_limits(self) -> DataFrame:
        return self.limits.filter(F.col("status") == "active")

    @property
    def items(self) -> DataFrame:
        """One row per collateral item; attributes come from its lowest loan id."""
        return (
            self.collateral.groupBy("collateral_id")
            .agg(
                F.min_by(F.struct(*ITEM_ATTRIBUTES), "securing_loan_id").alias("a"),
                F.count("*").alias("n_rows"),
            )
            .select("collateral_id", "a.*", "n_rows")
        )

    @property
    def lenders(self) -> DataFrame:
        return self.loans.select(F.col("lender_entity_id").alias("entity_id")).distinct()
