"""A lending book derived from order tables (customer, nation, orders).

Customers become legal entities in an acyclic ownership forest, orders become
loans; guarantees, collateral and limits follow from integer arithmetic on the
ids, so any engine derives the same book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.plans.staging import stage

LENDER_ID = -1
LENDER_CAPITAL = 100_000_000
CURRENCY = "SGD"
MONEY18 = "decimal(18,2)"

SECTOR_OF_SEGMENT = {
    "AUTOMOBILE": "industrials",
    "BUILDING": "commercial real estate",
    "FURNITURE": "consumer",
    "MACHINERY": "energy",
    "HOUSEHOLD": "financial services",
}
TYPE_OF_REMAINDER = {0: "nbfi", 1: "bank", 2: "government"}
RATING_OF_REMAINDER = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC")


def _parent(customer: Column) -> Column:
    return F.when(customer % 4 != 0, ((customer - customer % 4) / 4).cast("bigint"))


def _pick(value: Column, options: dict) -> Column:
    out = None
    for key, label in options.items():
        out = F.when(value == key, label) if out is None else out.when(value == key, label)
    return out


def entities(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    rating = _pick(key % 8, dict(enumerate(RATING_OF_REMAINDER)))
    names = customer.join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left"
    ).select(
        key.alias("entity_id"),
        F.col("c_name").alias("entity_name"),
        _pick(key % 7, TYPE_OF_REMAINDER).otherwise("corporate").alias("counterparty_type"),
        _pick(F.col("c_mktsegment"), SECTOR_OF_SEGMENT).alias("sector"),
        _parent(key).alias("parent_entity_id"),
        F.lit(None).cast(MONEY18).alias("eligible_capital"),
        F.when(key % 7 > 2, F.abs(F.col("c_acctbal")).cast(MONEY18) * 1000)
        .cast(MONEY18)
        .alias("annual_revenue"),
        F.col("n_name").alias("country"),
        rating.alias("rating"),
        F.lit("active").alias("status"),
    )
    lender = customer.sparkSession.range(1).select(
        F.lit(LENDER_ID).cast("bigint").alias("entity_id"),
        F.lit("Lender").alias("entity_name"),
        F.lit("bank").alias("counterparty_type"),
        F.lit("financial services").alias("sector"),
        F.lit(None).cast("bigint").alias("parent_entity_id"),
        F.lit(LENDER_CAPITAL).cast(MONEY18).alias("eligible_capital"),
        F.lit(None).cast(MONEY18).alias("annual_revenue"),
        F.lit("NATION_0").alias("country"),
        F.lit("AAA").alias("rating"),
        F.lit("active").alias("status"),
    )
    return names.unionByName(lender)


def loans(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("loan_id"),
        F.lit(LENDER_ID).cast("bigint").alias("lender_entity_id"),
        F.col("o_custkey").alias("borrower_entity_id"),
        F.col("o_totalprice").cast(MONEY18).alias("exposure_amount"),
        F.lit(CURRENCY).alias("currency"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") + key % 4)
        .cast("int")
        .alias("maturity_years"),
    )


def guarantees(loan: DataFrame, customer: DataFrame) -> DataFrame:
    n = customer.agg(F.count("*").alias("n")).scalar()
    borrower = F.col("borrower_entity_id")
    offers = F.array(
        F.struct((F.col("loan_id") * 2).alias("id"), ((borrower * 31 + 17) % n).alias("by")),
        F.when(
            F.col("loan_id") % 50 == 0,
            F.struct(
                (F.col("loan_id") * 2 + 1).alias("id"), ((borrower * 17 + 5) % n).alias("by")
            ),
        ),
    )
    return (
        loan.filter(F.col("loan_id") % 10 == 0)
        .select("loan_id", "borrower_entity_id", "exposure_amount", F.explode(offers).alias("g"))
        .filter(F.col("g").isNotNull() & (F.col("g.by") != borrower))
        .select(
            F.col("g.id").alias("guarantee_id"),
            F.col("g.by").alias("guarantor_entity_id"),
            F.col("loan_id").alias("beneficiary_loan_id"),
            F.col("exposure_amount").alias("amount"),
            F.lit(CURRENCY).alias("currency"),
            F.lit("active").alias("status"),
        )
    )


def collateral(loan: DataFrame, customer: DataFrame) -> DataFrame:
    n = customer.agg(F.count("*").alias("n")).scalar()
    key = F.col("loan_id")
    pairs = loan.filter(key % 20 < 6).select(
        F.when(key % 20 < 2, key - key % 20).otherwise(key).alias("collateral_id"),
        key.alias("securing_loan_id"),
        "borrower_entity_id",
        "exposure_amount",
    )
    item = F.col("collateral_id")
    pledged = F.col("pledged_by_entity_id")
    attributes = (
        pairs.groupBy("collateral_id")
        .agg(
            F.min("exposure_amount").alias("least"),
            F.min("borrower_entity_id").alias("pledged_by_entity_id"),
        )
        .select(
            "collateral_id",
            F.concat(F.lit("Item "), item.cast("string")).alias("collateral_type"),
            "pledged_by_entity_id",
            F.when(item % 3 == 1, ((pledged - pledged % 4) / 4).cast("bigint"))
            .when(item % 3 == 2, (pledged * 13 + 7) % n)
            .alias("issuer_entity_id"),
            F.when(item % 11 != 0, (F.col("least") * F.lit(0.5).cast("decimal(2,1)")).cast(MONEY18)).alias(
                "collateral_value"
            ),
            (F.lit(10) * (item % 5)).cast("int").alias("haircut_pct"),
            F.lit("active").alias("status"),
        )
    )
    return pairs.select("collateral_id", "securing_loan_id").join(attributes, "collateral_id")


def limits(entity: DataFrame) -> DataFrame:
    key = F.col("entity_id")
    return entity.filter(
        (key != LENDER_ID) & (F.col("parent_entity_id").isNull() | (key % 10 == 1))
    ).select(
        key.alias("limit_id"),
        key.alias("entity_id"),
        (F.lit(2_500_000) * (key % 5 + 1)).cast(MONEY18).alias("single_name_limit"),
        F.lit(CURRENCY).alias("currency"),
        F.lit("active").alias("status"),
    )


def orders_book(spark: SparkSession, directory: str) -> Book:
    """Book over ``{directory}/customer.parquet``, ``nation.parquet`` and ``orders.parquet``."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    customer = table("customer")
    entity = entities(customer, table("nation"))
    loan = loans(table("orders"))
    return Book(
        entities=entity,
        loans=loan,
        guarantees=guarantees(loan, customer),
        collateral=collateral(loan, customer),
        limits=limits(entity),
    )


def staged(book: Book) -> Book:
    """The same book as Parquet tables in the shared folder, for many queries over one book."""
    return Book(**{name: stage(df, name) for name, df in book.tables().items()})
