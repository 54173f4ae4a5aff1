"""Plan shape: no pair joins, pruned scans, pushed filters, no Python workers."""

import re

import pytest

from linkbook.catalog.queries import BOOK_QUERIES, book_of, present
from linkbook.operators import credit, exposure
from linkbook.plans import staging

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    return book_of(spark, FOLDER)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# These write tables while they are built, which the other tests cover.
EAGER = {"csv_round_trip", "store_reload", "saved_changes", "guarded_import", "guarded_import_strict", "default_cascade_multiround"}


@pytest.mark.parametrize("name", sorted(set(BOOK_QUERIES) - EAGER))
def test_no_pair_joins_and_no_python(spark, book, name):
    plan = plan_of(present(BOOK_QUERIES[name](spark, book)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_direct_exposure_reads_three_columns(book):
    plan = plan_of(exposure.direct_exposure(book))
    (columns,) = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert columns.count(":") == 3
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,active)]" in plan


def test_direct_exposure_shuffles_once_with_partial_sums(book):
    plan = plan_of(exposure.direct_exposure(book))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_scenarios_read_loans_once(book):
    from linkbook.operators.scenarios import SCENARIOS, summary_by_scenario

    one = plan_of(credit.portfolio_summary(book)).count("FileScan")
    assert plan_of(summary_by_scenario(book, SCENARIOS)).count("FileScan") <= one


def test_staging_needs_a_shared_folder_off_local(spark, monkeypatch, tmp_path):
    class Context:
        master, applicationId = "yarn", "a"

    class Conf:
        value = None

        def get(self, *_):
            return self.value

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
    Session.conf.value = "hdfs://x/checkpoints"
    assert staging.shared_dir(Session()) == "hdfs://x/checkpoints"


def test_a_hot_key_is_split(spark):
    """A third of the loans and guarantees on one name: adaptive execution splits that partition."""
    from books import entity, make_book

    from linkbook.schema import typed_schema

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        base = make_book(spark, entities=[entity(f"E{i}") for i in range(300)])
        base.ownership  # noqa: B018
        n = 60_000
        loans = spark.range(0, n, 1, 16).selectExpr(
            "cast(id as string) loan_id", "'L' lender_entity_id",
            "case when id % 3 = 0 then 'E7' else concat('E', id % 300) end borrower_entity_id",
            "cast(10 as decimal(20,2)) exposure_amount", "'SGD' currency", "'active' status", "3 maturity_years",
        )
        assert set(loans.columns) == set(typed_schema("loans").names)
        book = base.with_tables(loans=loans)
        owners = exposure.risk_owners(book)
        assert owners.groupBy("owner").count().filter("owner = 'E7'").first()["count"] == n // 3 + n // 300
        owners.collect()
        final = owners._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
        # The per-head totals never see the hot rows: they are summed before any shuffle.
        head = exposure.connected_exposure(book).filter("head = 'E7'").first()
        assert head.connected == 10 * (n // 3 + n // 300)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
