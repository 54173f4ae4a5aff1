"""Published and hand-checked figures of the calm and stressed books."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from linkbook.operators import concentration as C
from linkbook.operators import contagion, credit, exposure, ifrs9, limits, macro, mitigation
from linkbook.operators import reverse_stress as R
from linkbook.operators import scenarios as S
from linkbook.operators import wrong_way, xva
from linkbook.plans.ordering import ordered

M = 1_000_000


def by(df, key, *columns):
    return {r[key]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def test_connected_parts(stressed, calm):
    got = by(exposure.connected_exposure(stressed), "head", "direct", "guarantees_given", "shared_collateral")
    assert got["LE-0001"] == (20 * M, 7 * M, 7 * M)
    assert got["LE-0030"] == (5 * M, 42 * M, 0)
    assert got["LE-0020"] == (24 * M, 0, 0)
    assert by(exposure.connected_exposure(calm), "head", "connected")["LE-0030"] == 9 * M


def test_watchlist(stressed, calm):
    rows = ordered(limits.watchlist(stressed), "watchlist").collect()
    assert [(r.entity_id, r.band) for r in rows[:3]] == [
        ("LE-0030", "red"), ("LE-0001", "red"), ("LE-0020", "red")]
    assert rows[0].utilisation == pytest.approx(1.88)
    assert limits.band_counts(limits.watchlist(stressed)).first().asDict() == {"red": 3, "amber": 4, "green": 17}
    assert {r.entity_id for r in limits.near_limit(stressed).collect()} == {
        "LE-0030", "LE-0001", "LE-0020", "LE-0010", "LE-0021", "LE-0022", "LE-0023"}
    assert limits.near_limit(calm).count() == 0


def test_concentration(stressed, calm):
    h = C.hhi_direct_connected(stressed).first()
    assert (round(h.direct_hhi, 6), round(h.connected_hhi, 6)) == (0.044414, 0.187264)
    c = C.cr_direct_connected(stressed).first()
    assert (round(c.direct_cr, 6), round(c.connected_cr, 6)) == (0.546099, 0.914894)
    h, c = C.hhi_direct_connected(calm).first(), C.cr_direct_connected(calm).first()
    assert (round(h.direct_hhi, 6), round(h.connected_hhi, 6)) == (0.038918, 0.059504)
    assert (round(c.direct_cr, 6), round(c.connected_cr, 6)) == (0.435644, 0.623762)
    top = C.top_bucket(C.sector_shares(stressed)).first()
    assert (top.bucket, round(top.share, 4)) == ("financial services", 0.5177)
    assert {k: round(v, 4) for k, v in by(C.country_shares(stressed), "bucket", "share").items()} == {
        "SG": 0.7589, "HK": 0.1702, "MY": 0.0426, "ID": 0.0284}
    assert {k: round(v, 4) for k, v in by(C.rating_shares(stressed), "bucket", "share").items()} == {
        "BB": 0.5603, "A": 0.2057, "BBB": 0.1915, "B": 0.0213, "AAA": 0.0213}
    assert round(C.sub_investment_grade_share(stressed).first()[0], 4) == 0.5816
    flagged = {(r.metric, r.key) for r in C.threshold_flags(stressed).filter("flagged").collect()}
    assert flagged == {("connected HHI", "book"), ("connected CR10", "book"), ("sector share", "financial services")}
    # The calm book's connected top-ten ratio is above the 60 % line too.
    assert {r.metric for r in C.threshold_flags(calm).filter("flagged").collect()} == {"connected CR10"}


def test_attribution_keeps_the_book(stressed):
    got = by(exposure.attributed_vector(stressed), "owner", "exposure")
    assert {k: got[k] for k in ("LE-0030", "LE-0001", "LE-0020", "LE-0010", "LE-0048")} == {
        "LE-0030": 47 * M, "LE-0001": 27 * M, "LE-0020": 24 * M, "LE-0010": 10 * M, "LE-0048": 7 * M}
    assert sum(got.values()) == 141 * M
    assert exposure.risk_owners(stressed).agg(F.sum("exposure")).first()[0] == 141 * M
    assert exposure.top_counterparties(stressed).first().owner == "LE-0030"


def test_ubo_breach_without_subsidiary_breach(stressed):
    row = {r["head"]: r for r in limits.subsidiary_breach_check(stressed).collect()}["LE-0020"]
    assert row.ubo_breaches and row.subsidiary_breaches == 0 and row.ubo_connected == 24 * M
    rows = ordered(
        limits.ubo_aggregation(stressed, stressed.entities.filter("entity_id = 'LE-0021'").select("entity_id")),
        "ubo_aggregation").collect()
    assert rows[0].entity_id == "LE-0020" and rows[0].is_ubo and len(rows) == 4


def test_wrong_way(stressed, calm):
    (flag,) = wrong_way.structural_wwr(stressed).collect()
    assert (flag.loan_id, flag.collateral, flag.issuer, flag.group) == ("LN-1030", "COL-3002", "LE-0010", "LE-0010")
    assert wrong_way.structural_wwr(calm).count() == 0
    assert by(wrong_way.general_wwr(stressed), "loan_id", "driver") == {"LN-1040": "sector"}
    assert by(wrong_way.general_wwr(calm), "loan_id", "driver") == {"LN-1030": "country", "LN-1040": "sector"}


def test_credit(stressed, calm):
    s = credit.portfolio_summary(stressed).first()
    assert (s.total_ead, s.total_el, s.total_rwa, s.total_capital) == (127_100_000, 811_287, 133_220_000, 10_657_600)
    assert s.capital_pct_eligible == pytest.approx(0.106576)
    s = credit.portfolio_summary(calm).first()
    assert (s.total_ead, s.total_el, s.total_capital) == (88_250_000, Decimal("491519.25"), 7_218_400)
    net = by(mitigation.net_exposure(stressed), "entity_id", "net")
    assert net["LE-0048"] == 7 * M  # a shared item gives nothing


def test_provisions(stressed, calm):
    rows = by(ifrs9.staging_summary(stressed), "stage", "names", "ead", "ecl")
    assert rows[1] == (14, 64_200_000, Decimal("60237.00"))
    assert rows[2] == (13, 62_900_000, Decimal("3817507.11"))
    assert rows[3] == (0, 0, 0)
    assert ifrs9.total_ecl(stressed).first()[0] == Decimal("3877744.11")
    assert by(ifrs9.staging_summary(calm), "stage", "ecl")[2] == Decimal("1471780.23")


def test_valuation_adjustments(stressed, calm):
    t = xva.xva_totals(stressed).first()
    assert [str(t[c]) for c in ("cva", "dva", "fva", "mva", "kva", "total_xva")] == [
        "2460214.23", "4097.05", "5062994.94", "1821476.09", "4343310.04", "13683898.25"]
    t = xva.xva_totals(calm).first()
    assert str(t.total_xva) == "5948810.31" and str(t.cva) == "801325.87"
    assert xva.total_cva(stressed).first()[0] == Decimal("2460214.23")
    one = xva.exposure_profiles(stressed).filter("entity_id = 'LE-0041'").orderBy("t").collect()
    assert [p.t for p in one] == [0, 1, 2] and one[0].ee == one[0].pfe == 2 * M


def test_scenarios(stressed):
    got = by(S.snapshots(stressed), "scenario", "total_ead", "total_el", "total_capital")
    assert {k: (v[1], v[2]) for k, v in got.items()} == {
        "base": (811_287, 10_657_600), "nbfi_downgrade": (2_652_237, 11_013_600),
        "broad_downgrade": (3_413_799, 12_613_600), "haircut_plus20": (823_455, 10_952_000),
        "cre_downturn": (890_037, 11_577_600)}
    assert got["haircut_plus20"][0] == 131_100_000 and got["cre_downturn"][0] == 133_600_000
    base = {r.scenario: r for r in S.snapshots(stressed).collect()}["base"]
    assert (base.top_rating, base.watchlist_red, base.watchlist_amber) == ("BB", 3, 4)
    # One job for all scenarios equals one book per scenario.
    for shock in S.SCENARIOS:
        alone = credit.portfolio_summary(S.apply_shock(stressed, shock)).first()
        assert (alone.total_ead, alone.total_el) == got[shock.key][:2]
    deltas = S.expected_loss_deltas(stressed)
    assert deltas.filter("el_delta < 0").count() == 0
    assert S.compare(stressed).filter("scenario = 'cre_downturn'").first().total_el_base == 811_287


def test_macro(stressed):
    got = by(macro.macro_compare(stressed), "scenario", "total_el", "names_downgraded", "total_notches")
    assert got == {
        "base": (811_287, 0, 0),
        "property_crash": (Decimal("5519974.5"), 27, 42), "rates_shock": (Decimal("3008974.5"), 18, 32),
        "recession": (Decimal("6950974.5"), 27, 54), "stagflation": (Decimal("6608974.5"), 27, 64)}
    impact = macro.sector_impacts(stressed).filter("scenario = 'recession'")
    assert impact.agg(F.sum("el_shocked")).first()[0] == Decimal("6950974.5")


def test_reverse_stress(stressed, spark):
    targets = spark.createDataFrame(
        [("expected_loss", None, 2.0), ("capital_pct_eligible", 0.15, None), ("limit_breaches", 6.0, None),
         ("expected_loss", 1e12, None), ("expected_loss", 1.0, None)],
        "metric string, target double, multiple double")
    rows = {(r.metric, r.target): r for r in R.min_shock(R.severity_grid(stressed), targets).collect()}
    assert rows["expected_loss", 2 * 811_287].severity == 1
    capital = rows["capital_pct_eligible", 0.15]
    assert capital.severity == 3 and capital.achieved == pytest.approx(0.15208)
    breaches = rows["limit_breaches", 6.0]
    assert (breaches.severity, breaches.achieved, breaches.shock_label) == (3, 7, "+30% exposure uplift")
    assert not rows["expected_loss", 1e12].feasible
    assert rows["expected_loss", 1.0].severity == 1  # already met, severity 0 is never tried


def test_contagion(stressed, calm):
    rows = ordered(contagion.cascade(stressed), "cascade").collect()
    assert (rows[0].seed, rows[0].direct_loss, rows[0].contagion_loss) == ("LE-0030", 2_250_000, 18_900_000)
    assert rows[0].amplification == pytest.approx(9.4)
    losses = {r.seed: r.total_loss for r in rows}
    assert losses["LE-0001"] == 12_150_000 and losses["LE-0020"] == 10_800_000 and losses["LE-0010"] == 4_500_000
    rows = ordered(contagion.cascade_multiround(stressed), "multiround").collect()
    top = rows[0]
    assert (top.seed, top.rounds, top.defaulted, top.second_order, top.firesale_haircut) == ("LE-0045", 2, 5, 4, 0.115)
    assert top.total_loss == pytest.approx(15_265_384.62, abs=0.01)
    losses = {r.seed: r.total_loss for r in rows}
    assert losses["LE-0020"] == pytest.approx(13_107_692.31, abs=0.01)
    assert losses["LE-0001"] == pytest.approx(11_307_692.31, abs=0.01)
    top = ordered(contagion.cascade_multiround(calm), "multiround").first()
    assert (top.seed, top.rounds, top.firesale_haircut) == ("LE-0020", 1, 0.1)
    assert top.total_loss == pytest.approx(6_050_000)


def test_headline_and_breakdown(spark):
    from books import entity, guarantee, item, loan, make_book

    book = make_book(
        spark,
        entities=[entity("L", kind="bank"), entity("A"), entity("B", "A"), entity("C", "A"), entity("D", "B"),
                  entity("G"), entity("I"), entity("K")],
        loans=[loan("1", "B", 5 * M), loan("2", "D", 3 * M), loan("3", "A", 2 * M), loan("4", "G", 4 * M),
               loan("5", "I", 1_500_000), loan("6", "K", 7 * M)],
        guarantees=[guarantee("g1", "A", "4", 4 * M), guarantee("g2", "K", "5", M)],
        collateral=[item("c1", "1"), item("c1", "5"), item("c2", "2")],
        limits=[("l1", "A", str(12 * M), "SGD")],
    )
    heads = book.entities.filter("entity_id = 'A'").select(F.col("entity_id").alias("head"))
    for mode in exposure.STATUS_MODES:
        h = exposure.headline(book, heads, mode).first()
        assert (h.direct_head_only, h.direct_group, h.connected, h.group_limit) == (2 * M, 10 * M, 15_500_000, 12 * M)
        assert h.limit_breached and h.hidden == 13_500_000
    rows = exposure.breakdown(book, heads).collect()
    assert sum(r.amount for r in rows) == 15_500_000 and len(rows) == 5
    links = {(r.contribution_type, r.via, r.via_detail, r.outside_loan) for r in rows}
    assert {x for x in links if x[0][0] == "1"} == {(exposure.DIRECT, i, f"Loan {i}", None) for i in "123"}
    assert {x for x in links if x[0][0] != "1"} == {
        (exposure.GUARANTY, "g1", "Guaranty g1", "4"), (exposure.SHARED, "c1", "Item c1", "5")
    }
    view = exposure.group_view(book, heads)
    assert view["contributions"].count() == 5


def test_nbfi_cascade(stressed):
    nbfi = stressed.entities.filter("entity_id = 'LE-0030'").select(F.col("entity_id").alias("nbfi"))
    rows = ordered(exposure.nbfi_cascade(stressed, nbfi), "nbfi_cascade").collect()
    assert [r.contribution_type for r in rows] == ["1. direct"] + ["2. guarantee cascade"] * 6
    totals = by(exposure.nbfi_cascade_totals(stressed).filter("nbfi = 'LE-0030'"), "contribution_type", "amount")
    assert totals == {"1. direct": 5 * M, "2. guarantee cascade": 42 * M}


def test_pre_deal(stressed, spark):
    deals = spark.createDataFrame(
        [("d1", "LE-0041", 1_000_000, 3), ("d2", "LE-0021", 1_000_000, 9), ("d3", "LE-0041", 8_000_000, 3),
         ("d4", "LE-0053", 4_000_000, 2)],
        "deal_id string, borrower_id string, amount bigint, tenor int")
    got = {r.deal_id: r for r in limits.pre_deal_check(stressed, deals).collect()}
    assert got["d1"].ok and got["d1"].reasons == []
    assert got["d2"].ubo == "LE-0020" and got["d2"].effective_limit == 16 * M and len(got["d2"].reasons) == 2
    assert got["d3"].limit_ok and not got["d3"].settlement_ok
    assert got["d4"].rating == "B" and got["d4"].effective_limit == 15 * M and not got["d4"].settlement_ok
