"""Guarded import: check everything, then load all of it, the good part, or nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.operators.validation import accepted_rows, check_records, report_totals
from linkbook.plans.staging import stage
from linkbook.sources.csv_folder import RawTables, to_book
from linkbook.sources.store import save


@dataclass(frozen=True)
class ImportReport:
    dataset: str
    loaded: bool
    accepted: int
    rejected: int
    records: DataFrame  # table, record_id, accepted, reasons
    audit: DataFrame  # one audit record

    @property
    def total(self) -> int:
        return self.accepted + self.rejected

    def rejections(self) -> DataFrame:
        return self.records.filter(~F.col("accepted"))


def import_dataset(
    spark: SparkSession,
    raw: RawTables,
    root: str,
    dataset: str,
    actor: str = "importer",
    role: str = "group_risk",
    allow_partial: bool = False,
    strict: bool = True,
) -> ImportReport:
    """Validate, report and load a dataset into the store under its own name.

    Nothing is written unless every record passes; ``allow_partial`` loads the
    accepted records. Other datasets in the store are never touched.
    """
    records = stage(check_records(raw, strict), "report")
    totals = report_totals(records).first()
    accepted, rejected = totals["accepted"], totals["rejected"]
    loaded = rejected == 0 or allow_partial
    if loaded:
        save(to_book(raw if rejected == 0 else accepted_rows(raw, records)), root, dataset)
    reason = f"imported '{dataset}': {accepted} accepted, {rejected} rejected" + (
        "" if loaded else " (nothing written)"
    )
    audit = spark.range(1).select(
        F.lit("import").alias("action"),
        F.lit(dataset).alias("target"),
        F.lit(actor).alias("actor"),
        F.lit(role).alias("role"),
        F.lit("accepted" if loaded else "rejected").alias("outcome"),
        F.lit(reason).alias("reason"),
        F.create_map(
            F.lit("accepted"),
            F.lit(str(accepted)),
            F.lit("rejected"),
            F.lit(str(rejected)),
            F.lit("allow_partial"),
            F.lit(str(allow_partial).lower()),
        ).alias("payload"),
        F.array().cast("array<string>").alias("flags"),
    )
    return ImportReport(dataset, loaded, accepted, rejected, records, audit)
