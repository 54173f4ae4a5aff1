"""Every operator as a named query over the book derived from the order tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkbook.book import Book
from linkbook.functions.ratings import notch_down
from linkbook.functions.text import local_name
from linkbook.operators import access, audit, changes, concentration, contagion, credit
from linkbook.operators import exposure, filters, ifrs9, limits, macro, mitigation, ownership
from linkbook.operators import reverse_stress, scenarios, validation, wrong_way, xva
from linkbook.operators.dashboard import dashboard
from linkbook.operators.importing import import_dataset
from linkbook.plans.prefix import totals_before
from linkbook.plans.staging import scratch, stage
from linkbook.schema import COLUMNS
from linkbook.sources import audit_log, csv_folder, store, triples
from linkbook.sources.orders_book import orders_book, staged

_books: dict[tuple, Book] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table was last written, and its length."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(hadoop_path).getModificationTime(), files.getContentSummary(hadoop_path).getLength()


def book_of(spark: SparkSession, directory: str) -> Book:
    """The derived book, written once per application and state of the tables, and then re-read."""
    stamps = [_stamp(spark, f"{directory}/{t}.parquet") for t in ("customer", "nation", "orders")]
    key = (spark.sparkContext.applicationId, directory, *stamps)
    if key not in _books:
        _books[key] = staged(orders_book(spark, directory))
    return _books[key]


def present(df: DataFrame) -> DataFrame:
    """Plain output types: bigint, double, string, boolean; fine decimals at two places."""

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double") if kind.scale <= 4 else c.cast("decimal(38,2)").cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws("; ", c)
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def fixed(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at four places, half up, after dropping binary noise at eight."""
    return df.withColumns(
        {c: F.col(c).cast("decimal(28,8)").cast("decimal(24,4)") for c in columns}
    )


# --- parameters derived from the data ---------------------------------------


def breaching_heads(book: Book) -> DataFrame:
    """Every name at or over its limit: the ones a reader drills into."""
    return limits.limit_breaches(book).select(F.col("entity_id").alias("head"))


def nbfis(book: Book) -> DataFrame:
    return book.entities.filter(F.col("counterparty_type") == "nbfi").select(F.col("entity_id").alias("nbfi"))


def rollover_deals(book: Book) -> DataFrame:
    """A proposed renewal of every closed loan."""
    return book.loans.filter(F.col("status") == "closed").select(
        F.col("loan_id").alias("deal_id"),
        F.col("borrower_entity_id").alias("borrower_id"),
        F.col("exposure_amount").alias("amount"),
        (F.col("loan_id") % 10 + 1).cast("int").alias("tenor"),
    )


def cross_held(book: Book) -> Book:
    """Some roots owned by their own first child, which makes ownership cycles."""
    key = F.col("entity_id")
    child = key * 4 + 1
    ids = book.entities.select(key.alias("child"))
    loops = (
        book.entities.filter((key > 0) & (key % 8 == 4))
        .select("entity_id", child.alias("child"))
        .join(ids, "child", "left_semi")
    )
    entities = (
        book.entities.join(loops, "entity_id", "left")
        .withColumn("parent_entity_id", F.coalesce("parent_entity_id", "child"))
        .drop("child")
    )
    return book.with_tables(entities=entities)


def faulty_source(book: Book) -> dict[str, DataFrame]:
    """The book as text with faults on arithmetic positions, for the import checks."""

    def text(table: str) -> DataFrame:
        df = getattr(book, table)
        return df.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS[table]])

    def spoil(df: DataFrame, table: str, key: str, column: str, every: int, value: Column) -> DataFrame:
        hit = F.col(key).cast("bigint") % every == 0
        return df.withColumn(column, F.when(hit, value).otherwise(F.col(column)))

    lost = lambda c: F.concat(F.lit("X"), F.col(c))
    e = spoil(text("entities"), "entities", "entity_id", "counterparty_type", 97, F.lit("alien"))
    e = spoil(e, "entities", "entity_id", "sector", 101, F.lit(""))
    n = spoil(text("loans"), "loans", "loan_id", "borrower_entity_id", 83, lost("borrower_entity_id"))
    n = spoil(n, "loans", "loan_id", "exposure_amount", 89, F.lit("-5"))
    n = spoil(n, "loans", "loan_id", "exposure_amount", 103, F.lit("12x"))
    n = spoil(n, "loans", "loan_id", "status", 79, F.lit("pending"))
    # Some loans arrive twice with two amounts, some twice the same.
    again = n.filter(F.col("loan_id").cast("bigint") % 211 == 0).withColumn(
        "exposure_amount", F.lit("7")
    )
    same = n.filter(F.col("loan_id").cast("bigint") % 223 == 0)
    n = n.unionByName(again).unionByName(same)
    g = text("guarantees")
    g = spoil(g, "guarantees", "guarantee_id", "guarantor_entity_id", 71, lost("guarantor_entity_id"))
    g = spoil(g, "guarantees", "guarantee_id", "beneficiary_loan_id", 73, lost("beneficiary_loan_id"))
    g = spoil(g, "guarantees", "guarantee_id", "amount", 67, F.lit("0"))
    borrowers = n.select(
        F.col("loan_id").alias("beneficiary_loan_id"), "borrower_entity_id"
    ).groupBy("beneficiary_loan_id").agg(F.min("borrower_entity_id").alias("_b"))
    g = (
        g.join(borrowers, "beneficiary_loan_id", "left")
        .withColumn(
            "guarantor_entity_id",
            F.when(F.col("guarantee_id").cast("bigint") % 61 == 0, F.coalesce("_b", "guarantor_entity_id"))
            .otherwise(F.col("guarantor_entity_id")),
        )
        .select(*COLUMNS["guarantees"])
    )
    c = text("collateral")
    c = spoil(c, "collateral", "collateral_id", "pledged_by_entity_id", 59, lost("pledged_by_entity_id"))
    c = spoil(c, "collateral", "securing_loan_id", "securing_loan_id", 53, lost("securing_loan_id"))
    c = spoil(c, "collateral", "collateral_id", "haircut_pct", 47, F.lit("12.5"))
    c = spoil(c, "collateral", "collateral_id", "issuer_entity_id", 43, F.lit("X0"))
    x = spoil(text("limits"), "limits", "limit_id", "single_name_limit", 41, F.lit("0"))
    x = spoil(x, "limits", "limit_id", "entity_id", 37, lost("entity_id"))
    x = x.withColumn(
        "limit_id", F.when(F.col("entity_id").rlike("1$"), F.lit("")).otherwise(F.col("limit_id"))
    )
    return {"entities": e, "loans": n, "guarantees": g, "collateral": c, "limits": x}


def amount_changes(book: Book) -> DataFrame:
    """A new principal for every loan and a halved limit for every name, some requests faulty."""
    key = F.col("loan_id")
    loans = book.loans.select(
        (key * 2).alias("change_id"),
        F.when(key % 75 == 0, F.concat(F.lit("no such "), key.cast("string")))
        .otherwise(key.cast("string"))
        .alias("subject_id"),
        F.when(key % 125 == 0, "lender").otherwise("principalAmount").alias("field"),
        F.when(key % 175 == 0, "-1")
        .otherwise(F.floor(F.col("exposure_amount") * F.lit(1.1).cast("decimal(2,1)")).cast("string"))
        .alias("new_amount"),
        F.lit("group_risk").alias("role"),
    )
    key = F.col("limit_id")
    caps = book.limits.select(
        (key * 2 + 1).alias("change_id"),
        F.when(key % 27 == 0, F.lit("99999999999")).otherwise(key.cast("string")).alias("subject_id"),
        F.lit("limitAmount").alias("field"),
        F.floor(F.col("single_name_limit") / 2).cast("string").alias("new_amount"),
        F.when(key % 6 == 0, "relationship_manager").otherwise("group_risk").alias("role"),
    )
    return loans.unionByName(caps)


def deactivation_requests(book: Book) -> DataFrame:
    """Short loans, large guarantees and every entity, some under a bad or unknown id."""
    key = F.col("loan_id")
    loans = book.loans.filter(F.col("maturity_years") <= 3).select(
        key.cast("string").alias("subject_id"), F.lit("loan").alias("kind")
    )
    key = F.col("guarantee_id")
    given = book.guarantees.filter(F.col("amount") > 250_000).select(
        F.when(key % 180 == 0, F.concat(F.lit("bad id "), key.cast("string")))
        .otherwise(key.cast("string"))
        .alias("subject_id"),
        F.lit("guaranty").alias("kind"),
    )
    key = F.col("entity_id")
    names = book.entities.filter(key >= 0).select(
        F.when(key % 150 == 0, (key + 1_000_000_000).cast("string"))
        .otherwise(key.cast("string"))
        .alias("subject_id"),
        F.lit("entity").alias("kind"),
    )
    return loans.unionByName(given).unionByName(names)


def proposals(book: Book) -> dict[str, DataFrame]:
    """A new loan mirroring every loan, and a guarantee over each."""
    key = F.col("loan_id")
    loans = book.loans.select(
        (key + 1_000_000_000).alias("loan_id"),
        "lender_entity_id",
        F.when(key % 150 == 0, F.lit(-7)).otherwise(F.col("borrower_entity_id")).alias("borrower_entity_id"),
        F.when(key % 250 == 0, F.lit(0)).otherwise(F.col("exposure_amount")).alias("exposure_amount"),
        "currency",
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("maturity_years"),
    )
    given = book.loans.select(
        (key + 2_000_000_000).alias("guarantee_id"),
        (F.col("borrower_entity_id") + F.when(key % 300 == 0, 0).otherwise(1)).alias("guarantor_entity_id"),
        (key + 1_000_000_000).alias("beneficiary_loan_id"),
        F.lit(1000).alias("amount"),
        "currency",
    )
    return {"loans": loans, "guarantees": given}


def pending_changes(book: Book) -> DataFrame:
    """A pending deactivation of every active loan, some already approved."""
    key = F.col("loan_id")
    return book.active_loans.select(
        key.alias("id"),
        F.lit("loan").alias("kind"),
        key.cast("string").alias("subject_id"),
        F.concat(F.lit("user"), (key % 3).cast("string")).alias("maker"),
        F.lit("relationship_manager").alias("maker_role"),
        F.when(key % 60 == 0, "approved").otherwise("pending").alias("status"),
    )


def decisions(book: Book) -> DataFrame:
    """A decision on every loan, whether or not a change is pending for it."""
    key = F.col("loan_id")
    return book.loans.select(
        key.alias("id"),
        F.concat(F.lit("user"), (key % 4).cast("string")).alias("checker"),
        F.when(key % 70 == 0, "relationship_manager").otherwise("group_risk").alias("checker_role"),
        F.when(key % 80 == 0, "reject").otherwise("approve").alias("decision"),
    )


def managers(book: Book) -> DataFrame:
    """One principal per name: mostly managers of two groups, some group risk, some auditors."""
    key = F.col("entity_id")
    return book.entities.filter(key >= 0).select(
        F.concat(F.lit("P"), key.cast("string")).alias("principal"),
        F.when(key % 10 == 0, "group_risk")
        .when(key % 10 == 9, "auditor")
        .otherwise("relationship_manager")
        .alias("role"),
        F.array(key * 4, key + 1).alias("portfolios"),
    )


def audit_lines(book: Book) -> DataFrame:
    """:func:`_audit_lines` of the active loans."""
    return _audit_lines(book.active_loans)


def _audit_lines(numbers: DataFrame, *more: Column) -> DataFrame:
    """Audit lines of ``loan_id`` in chains of two records, some altered afterwards.

    An even ``seq`` opens a chain with the genesis hash, the odd one links to it, so
    verification reports the joints between chains, the gaps left by closed loans
    and the altered rows.
    """

    def line(seq: Column, target: Column, prev: Column, digest: Column | None, tampered: Column) -> Column:
        entry = F.lit("") if digest is None else F.concat(F.lit('"entry_hash": "'), digest, F.lit('", '))
        outcome = F.when(tampered, "rejected").otherwise("accepted")
        return F.concat(
            F.lit('{"action": "create-loan", "actor": "maker", "correlation_id": "c-'),
            seq.cast("string"),
            F.lit('", '),
            entry,
            F.lit('"flags": [], "outcome": "'),
            outcome,
            F.lit('", "payload": {}, "prev_hash": "'),
            prev,
            F.lit('", "reason": "written", "role": "group_risk", "seq": '),
            seq.cast("string"),
            F.lit(', "target": "'),
            target.cast("string"),
            F.lit('", "timestamp": "2024-01-01T00:00:00+00:00"}'),
        )

    never = F.lit(False)
    genesis = F.lit(audit.GENESIS)
    seq = F.col("loan_id")
    head = seq - seq % 2
    head_hash = F.sha2(line(head, head, genesis, None, never), 256)
    prev = F.when(seq % 2 == 0, genesis).otherwise(head_hash)
    digest = F.sha2(line(seq, seq, prev, None, never), 256)
    return numbers.select(line(seq, seq, prev, digest, seq % 97 == 0).alias("value"), *more)


def _log_in_order(spark: SparkSession, book: Book) -> DataFrame:
    """A log of all active loans, written as text with some neighbours in each other's place, and scanned."""
    ids = book.active_loans.select(F.col("loan_id").alias("id"), F.lit(1).cast("bigint").alias("one"))
    numbers = totals_before(ids, ["id"], {"loan_id": "one"}, "log-numbers").select("loan_id")
    seq = F.col("loan_id")
    place = seq + F.when(seq % 20 == 5, F.lit(1.5)).otherwise(F.lit(0.0))
    folder = scratch(spark, "log")
    _audit_lines(numbers, place.alias("place")).orderBy("place").select("value").write.text(folder)
    return audit.ordered_chain_problems(audit_log.numbered_lines(spark, folder))


# --- queries ----------------------------------------------------------------


def _csv_round_trip(spark: SparkSession, book: Book) -> DataFrame:
    folder = scratch(spark, "csv")
    csv_folder.write_book(book, folder)
    back = csv_folder.read_book(spark, folder)
    return (
        store.load_counts(back)
        .withColumn("amount", F.lit(None).cast("decimal(30,2)"))
        .filter(F.col("table") != "loans")
        .unionByName(
            back.loans.agg(
                F.lit("loans").alias("table"),
                F.count("*").alias("rows"),
                F.sum("exposure_amount").cast("decimal(30,2)").alias("amount"),
            )
        )
    )


def _store_reload(spark: SparkSession, book: Book) -> DataFrame:
    root = scratch(spark, "store")
    store.save(book, root, "calm")
    halved = book.with_tables(loans=book.active_loans)
    store.save(halved, root, "stressed")
    store.save(halved, root, "stressed")
    parts = [
        store.load_counts(store.load(spark, root, name)).withColumn("dataset", F.lit(name))
        for name in ("calm", "stressed")
    ]
    return parts[0].unionByName(parts[1])


def _saved_changes(spark: SparkSession, book: Book) -> DataFrame:
    """Amount updates, saved to the dataset they were read from."""
    root = scratch(spark, "store")
    store.save(book, root, "calm")
    store.save(_updated_book(store.load(spark, root, "calm")), root, "calm")
    return _changed_totals(book, store.load(spark, root, "calm"))


def _strict_import(spark: SparkSession, book: Book) -> DataFrame:
    """Clean input is loaded; faulty input afterwards leaves the store as it was."""
    root = scratch(spark, "import")
    folder = scratch(spark, "csv")
    csv_folder.write_book(book, folder)
    clean = import_dataset(spark, csv_folder.read_source(spark, folder), root, "mine")
    faulty = import_dataset(spark, faulty_source(book), root, "mine")
    counts = store.load_counts(store.load(spark, root, "mine"))
    return counts.withColumns({"clean_loaded": F.lit(clean.loaded), "faulty_loaded": F.lit(faulty.loaded)})


def _mapped_orders(spark: SparkSession, directory: str) -> DataFrame:
    mapping = csv_folder.TableMapping(
        "orders",
        {
            "loan_id": "o_orderkey",
            "lender_entity_id": "o_clerk_bank",
            "borrower_entity_id": "o_custkey",
            "exposure_amount": "o_totalprice",
            "currency": "o_currency",
            "status": "o_orderstatus",
        },
        {"status": {"F": "closed", "O": "active", "P": "active"}},
    )
    orders = spark.read.parquet(f"{directory}/orders.parquet")
    text = orders.select(
        F.col("o_orderkey").cast("string"),
        F.col("o_custkey").cast("string"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("o_totalprice"),
        "o_orderstatus",
        F.lit("B0").alias("o_clerk_bank"),
        F.lit("SGD").alias("o_currency"),
    )
    return csv_folder.typed(csv_folder.map_table(text, "loans", mapping), "loans")


def _triples(book: Book) -> DataFrame:
    rows = triples.distinct_triples(triples.triples(book))
    return (
        rows.select(local_name("p").alias("predicate"), triples.ntriples_line().alias("line"))
        .groupBy("predicate")
        .agg(F.count("*").alias("triples"), F.sum(F.length("line")).alias("chars"))
    )


def _guarded_import(spark: SparkSession, book: Book) -> DataFrame:
    root = scratch(spark, "import")
    report = import_dataset(spark, faulty_source(book), root, "mine", allow_partial=True)
    return store.load_counts(store.load(spark, root, "mine"))


def _creates(book: Book) -> DataFrame:
    return changes.apply_creates(book, proposals(book))[1]


def _changed_totals(before: Book, after: Book) -> DataFrame:
    """Active totals before and after a change, by table."""

    def totals(book: Book) -> DataFrame:
        rows = [
            book.active_loans.agg(F.lit("loans").alias("table"), F.count("*").alias("n"), F.sum("exposure_amount").alias("a")),
            book.active_guarantees.agg(F.lit("guarantees").alias("table"), F.count("*").alias("n"), F.sum("amount").alias("a")),
            book.active_limits.agg(F.lit("limits").alias("table"), F.count("*").alias("n"), F.sum("single_name_limit").alias("a")),
        ]
        out = rows[0].unionByName(rows[1]).unionByName(rows[2])
        return out.select("table", "n", F.col("a").cast("decimal(30,2)").alias("a"))

    old = totals(before).select("table", F.col("n").alias("rows_before"), F.col("a").alias("before"))
    new = totals(after).select("table", F.col("n").alias("rows_after"), F.col("a").alias("after"))
    return old.join(new, "table")


def _amount_updates(book: Book) -> DataFrame:
    asked = access.gate_limit_edits(amount_changes(book)).filter("allowed")
    return changes.apply_amounts(book, asked)[1]


def _updated_book(book: Book) -> Book:
    asked = access.gate_limit_edits(amount_changes(book)).filter("allowed")
    return changes.apply_amounts(book, asked)[0]


def _reverse_stress(book: Book) -> DataFrame:
    """Targets at several multiples of every base metric, from the grid itself."""
    grid = stage(reverse_stress.severity_grid(book), "grid")
    base = grid.filter(F.col("family") == "base").select("metric")
    targets = base.select(
        "metric",
        F.explode(F.array(*[F.lit(x) for x in (1.0, 1.25, 1.5, 2.0, 4.0)])).alias("multiple"),
    ).unionByName(
        base.filter(F.col("metric") == "capital").select("metric", F.lit(1.3).alias("multiple"))
    )
    return reverse_stress.min_shock(grid, targets)


def _downgrades(book: Book) -> DataFrame:
    lowered = [notch_down("rating", n).alias(f"down_{n}") for n in (1, 2, 6)]
    return book.entities.select("entity_id", "rating", *lowered)


def _scoped_dashboard(book: Book, part: str) -> DataFrame:
    """A part of the dashboard of a manager whose portfolio is the groups at or over their limits."""
    return dashboard(book, breaching_heads(book), (part,))[part]


def _filtered_el(book: Book) -> DataFrame:
    rows = credit.credit_risk(book)
    return filters.apply_filters(
        rows, {"rating": ["BB", "B", "CCC", "unrated"], "ead": (100_000, None)}
    ).select("entity_id", "rating", "sector", "ead", "el")


def _flagged_watchlist(book: Book) -> DataFrame:
    return filters.wwr_flagged(limits.watchlist(book), wrong_way.structural_wwr(book)).select(
        "entity_id", "connected", "band"
    )


def _macro_book(book: Book) -> DataFrame:
    """Names by grade in the book of every macro scenario."""
    parts = [
        macro.apply_macro(book, s.key).entities.groupBy("rating").agg(F.count("*").alias("names")).withColumn("scenario", F.lit(s.key))
        for s in macro.macro_shocks()
    ]
    return reduce(DataFrame.unionByName, parts)


def _allowed(book: Book) -> DataFrame:
    """The single decision for every principal on two groups of its own and one that is not."""
    key = F.col("entity_id")
    asked = managers(book).join(book.entities.select(F.concat(F.lit("P"), key.cast("string")).alias("principal"), "entity_id"), "principal")
    asked = asked.select("principal", "role", "portfolios", F.explode(F.array(key * 4, key + 1, key + 2)).alias("head"))
    return asked.select("principal", "head", access.allow(F.col("role"), F.col("portfolios"), F.col("head")).alias("allowed"))


def _reverse_search(book: Book) -> DataFrame:
    """Targets at multiples of the base, also far beyond the grid."""
    spark = book.loans.sparkSession
    rows = [(m, x, f) for m in reverse_stress.METRICS for x in (1.0, 1.5, 3.0, 12.0) for f in reverse_stress.FAMILIES]
    return reverse_stress.search(book, spark.createDataFrame(rows, "metric string, multiple double, family string"))


BookQuery = Callable[[SparkSession, Book], DataFrame]

BOOK_QUERIES: dict[str, BookQuery] = {
    # sources and sinks
    "book_load_counts": lambda s, b: store.load_counts(b),
    "csv_round_trip": _csv_round_trip,
    "store_reload": _store_reload,
    "saved_changes": _saved_changes,
    "collateral_items": lambda s, b: b.items,
    "triples_by_predicate": lambda s, b: _triples(b),
    # filters
    "filtered_expected_loss": lambda s, b: _filtered_el(b),
    "red_watchlist": lambda s, b: filters.apply_filters(limits.watchlist(b), {"band": ["red"]}).select("entity_id", "connected"),
    "second_order_cascades": lambda s, b: filters.second_order(contagion.cascade_multiround(b)).select("seed", "second_order"),
    "macro_hit_sectors": lambda s, b: filters.macro_hit(macro.notches_by_sector(b)).select("scenario", "sector", "notches"),
    "second_stage_names": lambda s, b: filters.apply_filters(ifrs9.counterparty_ecl(b), {"stage": [2, 3]}).select("entity_id", "stage", "ecl_recognised"),
    "energy_valuation": lambda s, b: filters.apply_filters(
        xva.counterparty_xva(b).join(b.entities.select("entity_id", "sector"), "entity_id"), {"sector": "energy", "cva": (1, None)}
    ).select("entity_id", "cva"),
    "wwr_flagged_watchlist": lambda s, b: _flagged_watchlist(b),
    # ownership
    "ultimate_parents": lambda s, b: ownership.ultimate_parents(b),
    "ownership_closure": lambda s, b: ownership.closure(b),
    "group_heads": lambda s, b: ownership.top_level_names(b),
    "group_sizes": lambda s, b: ownership.group_sizes(b),
    "ownership_cycle_objects": lambda s, b: ownership.cycles(cross_held(b)),
    "ownership_cycles": lambda s, b: ownership.cycle_report(cross_held(b)),
    # exposure
    "direct_exposure": lambda s, b: exposure.direct_exposure(b),
    "direct_vector": lambda s, b: exposure.direct_vector(b),
    "connected_exposure": lambda s, b: exposure.connected_exposure(b),
    "connected_vector": lambda s, b: exposure.connected_vector(b),
    "headline": lambda s, b: exposure.headline(b),
    "headline_any_status": lambda s, b: exposure.headline(b, status_mode="raw"),
    "headline_active_loans": lambda s, b: exposure.headline(b, status_mode="loans"),
    "breakdown_breaching_names": lambda s, b: exposure.breakdown(b, breaching_heads(b)),
    "group_view_contributions": lambda s, b: exposure.group_view(b, breaching_heads(b))["contributions"],
    "amplifying_cascades": lambda s, b: filters.amplifying(contagion.cascade(b)).select("seed", "contagion_loss"),
    "watchlist_of_nbfis": lambda s, b: filters.bind(
        limits.watchlist(b), "entity_id", nbfis(b).withColumnRenamed("nbfi", "entity_id")
    ).select("entity_id", "connected", "band"),
    "exposure_to_groups": lambda s, b: exposure.exposure_to_groups(b, exposure.top_level_names(b)),
    "nbfi_cascade_totals": lambda s, b: exposure.nbfi_cascade_totals(b),
    "nbfi_cascade": lambda s, b: exposure.nbfi_cascade(b, nbfis(b)),
    "risk_owners": lambda s, b: exposure.risk_owners(b),
    "attributed_exposure": lambda s, b: exposure.attributed_view(b),
    "top_counterparties": lambda s, b: exposure.top_counterparties(b),
    "guarantee_chains": lambda s, b: exposure.guarantee_chains(b),
    # concentration
    "hhi": lambda s, b: rounded(concentration.hhi_direct_connected(b), "direct_hhi", "connected_hhi", places=8),
    "cr10": lambda s, b: rounded(concentration.cr_direct_connected(b), "direct_cr", "connected_cr"),
    "sector_shares": lambda s, b: rounded(concentration.sector_shares(b), "share"),
    "country_shares": lambda s, b: rounded(concentration.country_shares(b), "share"),
    "rating_shares": lambda s, b: rounded(concentration.rating_shares(b), "share"),
    "sub_investment_grade_share": lambda s, b: rounded(
        concentration.sub_investment_grade_share(b), "sub_investment_grade_share"
    ),
    "top_sector": lambda s, b: rounded(concentration.top_bucket(concentration.sector_shares(b)), "share"),
    "government_share": lambda s, b: rounded(concentration.government_share(b), "share"),
    "threshold_flags": lambda s, b: rounded(concentration.threshold_flags(b), "value"),
    # limits
    "watchlist": lambda s, b: rounded(limits.watchlist(b), "utilisation"),
    "limit_breaches": lambda s, b: rounded(limits.limit_breaches(b), "utilisation"),
    "near_limit": lambda s, b: rounded(limits.near_limit(b, 0.5), "utilisation"),
    "band_counts": lambda s, b: limits.band_counts(limits.watchlist(b)),
    "ubo_aggregation": lambda s, b: rounded(limits.ubo_aggregation(b), "utilisation"),
    "subsidiary_breach_check": lambda s, b: limits.subsidiary_breach_check(b),
    "breaching_subsidiaries": lambda s, b: limits.breaching_subsidiaries(b),
    "pre_deal_check": lambda s, b: limits.pre_deal_check(b, rollover_deals(b)),
    "limit_basis_utilisation": lambda s, b: rounded(
        limits.limit_basis_utilisation(b), "of_capital", "of_revenue"
    ),
    # mitigation and credit risk
    "eligible_collateral": lambda s, b: mitigation.eligible_collateral(b),
    "net_exposure": lambda s, b: mitigation.net_exposure(b),
    "collateralised_names": lambda s, b: mitigation.collateralised_names(b),
    "credit_risk": lambda s, b: credit.credit_risk(b),
    "portfolio_summary": lambda s, b: rounded(credit.portfolio_summary(b), "capital_pct_eligible"),
    # provisioning and valuation
    "counterparty_ecl": lambda s, b: rounded(ifrs9.counterparty_ecl(b), "coverage"),
    "staging_summary": lambda s, b: ifrs9.staging_summary(b),
    "total_ecl": lambda s, b: ifrs9.total_ecl(b),
    "exposure_profiles": lambda s, b: fixed(xva.exposure_profiles(b), "ee", "pfe"),
    "counterparty_xva": lambda s, b: xva.counterparty_xva(b),
    "total_cva": lambda s, b: xva.total_cva(b),
    "xva_breakdown": lambda s, b: xva.xva_breakdown(b),
    "xva_totals": lambda s, b: xva.xva_totals(b),
    # stress
    "rating_downgrades": lambda s, b: _downgrades(b),
    "scenario_snapshots": lambda s, b: rounded(
        scenarios.snapshots(b), "capital_pct_eligible", "top_rating_share"
    ),
    "scenario_compare": lambda s, b: rounded(
        scenarios.compare(b).select(
            "scenario", "total_ead", "total_ead_base", "total_el", "total_el_base",
            "capital_pct_eligible", "capital_pct_eligible_base", "watchlist_red", "watchlist_red_base",
        ),
        "capital_pct_eligible",
        "capital_pct_eligible_base",
    ),
    "expected_loss_deltas": lambda s, b: scenarios.expected_loss_deltas(b),
    "macro_notches": lambda s, b: macro.notches_by_sector(b),
    "macro_book_ratings": lambda s, b: _macro_book(b),
    "macro_compare": lambda s, b: rounded(macro.macro_compare(b), "capital_pct_eligible"),
    "macro_sector_impacts": lambda s, b: macro.sector_impacts(b),
    "severity_grid": lambda s, b: rounded(reverse_stress.severity_grid(b), "value", places=2),
    "reverse_stress": lambda s, b: rounded(
        _reverse_stress(b), "target", "base_value", "achieved", places=2
    ),
    "reverse_stress_search": lambda s, b: rounded(_reverse_search(b), "target", "base_value", "achieved", places=2),
    # contagion and wrong-way risk
    "default_cascade": lambda s, b: rounded(contagion.cascade(b), "amplification"),
    "solvent_guaranteed_loans": lambda s, b: contagion.solvent_guaranteed_loans(
        b,
        ownership.ultimate_parents(b).select(F.col("ubo").alias("seed"), "entity_id"),
    ),
    "default_cascade_multiround": lambda s, b: rounded(
        contagion.cascade_multiround(b), "total_loss", "firesale_haircut", places=2
    ),
    "structural_wrong_way_risk": lambda s, b: wrong_way.structural_wwr(b),
    "general_wrong_way_risk": lambda s, b: wrong_way.general_wwr(b),
    # validation, changes, audit
    "import_totals": lambda s, b: validation.report_totals(validation.check_records(faulty_source(b))),
    "import_report": lambda s, b: validation.check_records(faulty_source(b)),
    "import_rejections": lambda s, b: validation.rejections_by_reason(
        validation.check_records(faulty_source(b))
    ),
    "duplicate_keys": lambda s, b: validation.duplicate_keys(faulty_source(b)),
    "guarded_import": _guarded_import,
    "guarded_import_strict": _strict_import,
    "create_outcomes": lambda s, b: _creates(b),
    "created_totals": lambda s, b: _changed_totals(b, changes.apply_creates(b, proposals(b))[0]),
    "amount_update_outcomes": lambda s, b: _amount_updates(b),
    "amount_update_totals": lambda s, b: _changed_totals(b, _updated_book(b)),
    "deactivation_outcomes": lambda s, b: changes.apply_deactivations(b, deactivation_requests(b))[1],
    "deactivation_totals": lambda s, b: _changed_totals(
        b, changes.apply_deactivations(b, deactivation_requests(b))[0]
    ),
    "change_flags": lambda s, b: changes.change_flags(b, _updated_book(b)),
    "flag_records": lambda s, b: changes.flag_records(b).select("action", "target", "outcome", "reason"),
    "approval_outcomes": lambda s, b: changes.resolve_approvals(pending_changes(b), decisions(b)),
    "audit_log_in_order": _log_in_order,
    "audit_chain_problems": lambda s, b: audit.chain_problems(audit_lines(b)),
    # access
    "group_grants": lambda s, b: access.grants(managers(b), access.candidate_groups(b)),
    "dashboard_hhi": lambda s, b: rounded(_scoped_dashboard(b, "hhi"), "direct_hhi", "connected_hhi", places=8),
    "dashboard_cr10": lambda s, b: rounded(_scoped_dashboard(b, "cr10"), "direct_cr", "connected_cr"),
    "dashboard_sectors": lambda s, b: rounded(_scoped_dashboard(b, "sectors"), "share"),
    "dashboard_countries": lambda s, b: rounded(_scoped_dashboard(b, "countries"), "share"),
    "dashboard_ratings": lambda s, b: rounded(_scoped_dashboard(b, "ratings"), "share"),
    "scoped_watchlist": lambda s, b: rounded(_scoped_dashboard(b, "watchlist"), "utilisation"),
    "scoped_wrong_way": lambda s, b: _scoped_dashboard(b, "wwr").select("loan_id", "borrower", "collateral", "issuer"),
    "group_access": lambda s, b: _allowed(b),
    "scoped_exposures": lambda s, b: _scoped_dashboard(b, "exposures"),
    "limit_edit_gate": lambda s, b: access.gate_limit_edits(amount_changes(b)).select(
        "change_id", "allowed", "refusal"
    ),
}


def _bind(query: BookQuery) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: present(query(spark, book_of(spark, directory)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable over (spark, folder of the order tables)."""
    out = {name: _bind(q) for name, q in BOOK_QUERIES.items()}
    out["mapped_orders"] = lambda spark, directory: present(_mapped_orders(spark, directory))
    return out
