"""DuckDB statements for the registered queries.

They restate each definition directly (anti-joins, loan pairs, recursive walks)
instead of following the DataFrame plans, so both sides check each other.
"""

from __future__ import annotations

from linkbook import params as P
from linkbook.operators import validation as V


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _c(x: str) -> str:
    """Cents, half up, as double."""
    return f"CAST(CAST({x} AS DECIMAL(38,2)) AS DOUBLE)"


def _b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _ratio(a: str, b: str) -> str:
    return f"COALESCE({_d(a)} / NULLIF({_d(b)}, 0), 0)"


BASE = """
n AS (SELECT COUNT(*) AS n FROM customer),
entities AS (
  SELECT c_custkey AS entity_id, c_name AS entity_name,
    CASE c_custkey % 7 WHEN 0 THEN 'nbfi' WHEN 1 THEN 'bank' WHEN 2 THEN 'government'
      ELSE 'corporate' END AS counterparty_type,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'industrials' WHEN 'BUILDING' THEN 'commercial real estate'
      WHEN 'FURNITURE' THEN 'consumer' WHEN 'MACHINERY' THEN 'energy'
      WHEN 'HOUSEHOLD' THEN 'financial services' END AS sector,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST((c_custkey - c_custkey % 4) // 4 AS BIGINT) END AS parent,
    CAST(NULL AS DECIMAL(18,2)) AS capital,
    CASE WHEN c_custkey % 7 > 2
      THEN CAST(CAST(abs(c_acctbal) AS DECIMAL(15,2)) * 1000 AS DECIMAL(18,2)) END AS revenue,
    n_name AS country,
    CASE c_custkey % 8 WHEN 0 THEN 'AAA' WHEN 1 THEN 'AA' WHEN 2 THEN 'A' WHEN 3 THEN 'BBB'
      WHEN 4 THEN 'BB' WHEN 5 THEN 'B' WHEN 6 THEN 'CCC' END AS rating
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT -1, 'Lender', 'bank', 'financial services', NULL, CAST(100000000 AS DECIMAL(18,2)), NULL,
    'NATION_0', 'AAA'),
loans AS (
  SELECT o_orderkey AS loan_id, CAST(-1 AS BIGINT) AS lender, o_custkey AS borrower,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'active' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + o_orderkey % 4 AS maturity
  FROM orders),
guarantees AS (
  SELECT 2 * loan_id AS guarantee_id, (31 * borrower + 17) % n AS guarantor, loan_id, amount
  FROM loans, n WHERE loan_id % 10 = 0 AND (31 * borrower + 17) % n <> borrower
  UNION ALL
  SELECT 2 * loan_id + 1, (17 * borrower + 5) % n, loan_id, amount
  FROM loans, n WHERE loan_id % 50 = 0 AND (17 * borrower + 5) % n <> borrower),
pairs AS (
  SELECT CASE WHEN loan_id % 20 < 2 THEN loan_id - loan_id % 20 ELSE loan_id END AS item, loan_id
  FROM loans WHERE loan_id % 20 < 6),
item_base AS (
  SELECT item, MIN(borrower) AS pledged, MIN(amount) AS least, COUNT(*) AS n_rows
  FROM pairs JOIN loans USING (loan_id) GROUP BY item),
items AS (
  SELECT item, pledged, n_rows,
    CASE WHEN item % 11 <> 0 THEN CAST(least * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,2)) END AS value,
    10 * (item % 5) AS haircut,
    CASE item % 3 WHEN 1 THEN CAST((pledged - pledged % 4) // 4 AS BIGINT)
      WHEN 2 THEN (13 * pledged + 7) % n END AS issuer
  FROM item_base, n),
limits AS (
  SELECT entity_id AS limit_id, entity_id, CAST(2500000 * (1 + entity_id % 5) AS DECIMAL(18,2)) AS cap
  FROM entities WHERE entity_id <> -1 AND (parent IS NULL OR entity_id % 10 = 1)),
anc(member, head, depth) AS (
  SELECT entity_id, entity_id, 0 FROM entities
  UNION ALL
  SELECT a.member, e.parent, a.depth + 1 FROM anc a JOIN entities e ON e.entity_id = a.head
  WHERE e.parent IS NOT NULL),
ubo AS (
  SELECT a.member AS entity_id, a.head AS ubo FROM anc a JOIN entities e ON e.entity_id = a.head
  WHERE e.parent IS NULL),
active AS (SELECT * FROM loans WHERE status = 'active'),
tops AS (
  SELECT entity_id AS head, entity_name FROM entities
  WHERE parent IS NULL AND entity_id NOT IN (SELECT lender FROM loans))"""


def _connected(name: str, loans: str, amount: str = "amount", inside_too: bool = False) -> str:
    outside = "" if inside_too else (
        "AND NOT EXISTS (SELECT 1 FROM anc b WHERE b.member = l.borrower AND b.head = a.head)"
    )
    guaranteed = "loans" if inside_too else loans
    return f"""
{name}_rows AS (
  SELECT a.head, 'd' AS kind, l.loan_id AS src, l.{amount} AS amount, a.depth
  FROM {loans} l JOIN anc a ON a.member = l.borrower
  UNION ALL
  SELECT a.head, 'g', g.guarantee_id, g.amount, 0
  FROM guarantees g JOIN {guaranteed} l ON l.loan_id = g.loan_id JOIN anc a ON a.member = g.guarantor
  WHERE TRUE {outside}
  UNION ALL
  SELECT DISTINCT a.head, 's', l.loan_id, l.{amount}, 0
  FROM pairs p1 JOIN {loans} l1 ON l1.loan_id = p1.loan_id JOIN anc a ON a.member = l1.borrower
  JOIN pairs p2 ON p2.item = p1.item JOIN {loans} l ON l.loan_id = p2.loan_id
  WHERE NOT EXISTS (SELECT 1 FROM anc b WHERE b.member = l.borrower AND b.head = a.head)),
{name} AS (
  SELECT head, SUM(CASE WHEN kind = 'd' AND depth = 0 THEN amount ELSE 0 END) AS own,
    SUM(CASE WHEN kind = 'd' THEN amount ELSE 0 END) AS direct,
    SUM(CASE WHEN kind = 'g' THEN amount ELSE 0 END) AS given,
    SUM(CASE WHEN kind = 's' THEN amount ELSE 0 END) AS shared,
    CAST(SUM(amount) AS DECIMAL(30,2)) AS connected
  FROM {name}_rows GROUP BY head)"""


CONNECTED = _connected("conn", "active")
WATCH = (
    CONNECTED
    + """,
watch AS (
  SELECT x.entity_id, e.entity_name, x.limit_id, COALESCE(c.connected, 0) AS connected, x.cap,
    CASE WHEN COALESCE(c.connected, 0) >= x.cap THEN 'red'
      WHEN COALESCE(c.connected, 0) >= x.cap * CAST(0.75 AS DECIMAL(3,2)) THEN 'amber'
      ELSE 'green' END AS band
  FROM limits x LEFT JOIN conn c ON c.head = x.entity_id JOIN entities e ON e.entity_id = x.entity_id),
top_watch AS (
  SELECT entity_id AS head FROM watch WHERE band = 'red')"""
)
OWNERS = """
reroute AS (
  SELECT g.loan_id, arg_min(gu.ubo, g.guarantee_id) AS owner
  FROM guarantees g JOIN active l ON l.loan_id = g.loan_id
  JOIN ubo gu ON gu.entity_id = g.guarantor JOIN ubo bu ON bu.entity_id = l.borrower
  WHERE gu.ubo <> bu.ubo GROUP BY g.loan_id),
owners AS (
  SELECT l.loan_id, l.borrower, COALESCE(r.owner, bu.ubo) AS owner, l.amount
  FROM active l JOIN ubo bu ON bu.entity_id = l.borrower LEFT JOIN reroute r ON r.loan_id = l.loan_id),
vec AS (SELECT owner, CAST(SUM(amount) AS DECIMAL(30,2)) AS exposure FROM owners GROUP BY owner),
direct AS (
  SELECT borrower AS name, CAST(SUM(amount) AS DECIMAL(30,2)) AS exposure FROM active GROUP BY borrower)"""


def _net(name: str, add: int = 0, amount: str = "amount", loans: str = "active") -> str:
    """Gross, mitigant and EAD per active borrower; needs DEDICATED."""
    return f"""
{name}_m AS (
  SELECT d.entity_id, CAST(SUM(i.value * CAST(100 - LEAST(100, i.haircut + {add}) AS DECIMAL(5,0))
    * CAST(0.01 AS DECIMAL(3,2))) AS DECIMAL(24,4)) AS mitigant
  FROM dedicated d JOIN items i ON i.item = d.item WHERE i.value IS NOT NULL GROUP BY d.entity_id),
{name} AS (
  SELECT g.entity_id, g.gross, g.tenor, COALESCE(m.mitigant, 0) AS mitigant,
    CAST(GREATEST(g.gross - COALESCE(m.mitigant, 0), 0) AS DECIMAL(18,4)) AS ead
  FROM (SELECT borrower AS entity_id, CAST(SUM({amount}) AS DECIMAL(24,2)) AS gross,
      MAX(maturity) AS tenor FROM {loans} GROUP BY borrower) g
  LEFT JOIN {name}_m m ON m.entity_id = g.entity_id)"""


DEDICATED = """
dedicated AS (
  SELECT p.item, MIN(l.borrower) AS entity_id FROM pairs p JOIN loans l ON l.loan_id = p.loan_id
  GROUP BY p.item HAVING MIN(l.borrower) = MAX(l.borrower) AND bool_and(l.status = 'active'))"""
RATES = """
rates(rating, pd, rw, factor, pos) AS (VALUES
  ('AAA', CAST(0.0001 AS DECIMAL(5,4)), CAST(0.20 AS DECIMAL(3,2)), CAST(1.20 AS DECIMAL(3,2)), 1),
  ('AA', 0.0002, 0.20, 1.10, 2), ('A', 0.0005, 0.50, 1.00, 3), ('BBB', 0.0025, 1.00, 1.00, 4),
  ('BB', 0.0100, 1.00, 0.80, 5), ('B', 0.0500, 1.50, 0.60, 6), ('CCC', 0.2000, 1.50, 0.40, 7))"""
PD = "COALESCE(r.pd, CAST(0.0100 AS DECIMAL(5,4)))"
RW = "COALESCE(r.rw, CAST(1.00 AS DECIMAL(3,2)))"
LGD = "CAST(0.45 AS DECIMAL(3,2))"
CREDIT = (
    DEDICATED
    + ","
    + _net("net")
    + ","
    + RATES
    + f""",
credit AS (
  SELECT x.entity_id, e.entity_name, e.sector, COALESCE(e.rating, 'unrated') AS rating, x.tenor, x.ead,
    {PD} AS pd, {RW} AS rw, x.ead * {PD} * {LGD} AS el, x.ead * {RW} AS rwa
  FROM net x JOIN entities e ON e.entity_id = x.entity_id LEFT JOIN rates r ON r.rating = e.rating)"""
)
CURVE = (
    CREDIT
    + """,
curve AS (
  SELECT *, CAST(ead AS DOUBLE) AS x, GREATEST(tenor, 1) AS hz, -ln(1.0 - CAST(pd AS DOUBLE)) AS h,
    -ln(1.0 - CAST(0.0001 AS DOUBLE)) AS own_h FROM credit),
years AS (
  SELECT c.*, CAST(y.t AS DOUBLE) AS t FROM curve c, LATERAL (SELECT unnest(range(0, c.hz + 1)) AS t) y),
points AS (
  SELECT *, x * (1.0 - t / hz) + 0.5 * (x * CAST(0.15 AS DOUBLE) * sqrt(t)) AS ee,
    0.5 * (x * CAST(0.15 AS DOUBLE) * sqrt(t)) AS half,
    exp(-CAST(0.03 AS DOUBLE) * t) AS df,
    CASE WHEN t > 0 THEN exp(-h * (t - 1.0)) - exp(-h * t) ELSE 0 END AS mpd,
    CASE WHEN t > 0 THEN exp(-own_h * (t - 1.0)) - exp(-own_h * t) ELSE 0 END AS own_mpd
  FROM years),
adjust AS (
  SELECT entity_id, rating, ANY_VALUE(ead) AS ead, ANY_VALUE(tenor) AS tenor, ANY_VALUE(pd) AS pd,
    MAX(ee + half) AS peak, AVG(ee) AS epe,
    CAST(CAST(SUM(CAST(0.45 AS DOUBLE) * ee * mpd * df) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS cva,
    CAST(CAST(SUM(CAST(0.45 AS DOUBLE) * half * own_mpd * df) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS dva,
    CAST(CAST(SUM(ee * CAST(0.01 AS DOUBLE) * df) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS fva,
    CAST(CAST(SUM(2.0 * half * CAST(0.01 AS DOUBLE) * df) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS mva,
    CAST(CAST(SUM(CAST(0.08 AS DOUBLE) * CAST(rw AS DOUBLE) * ee * CAST(0.1 AS DOUBLE) * df) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS kva,
    SUM(CAST(0.45 AS DOUBLE) * x * mpd * df) AS lifetime
  FROM points GROUP BY entity_id, rating),
ecl AS (
  SELECT entity_id, rating, CASE WHEN rating = 'CCC' THEN 3 WHEN rating IN ('unrated', 'BB', 'B') THEN 2 ELSE 1 END AS stage,
    CAST(ead AS DECIMAL(24,2)) AS ead,
    CAST(ead * pd * CAST(0.45 AS DECIMAL(3,2)) AS DECIMAL(24,2)) AS ecl_12m,
    CAST(CAST(lifetime AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS ecl_lifetime,
    CAST(ead * CAST(0.45 AS DECIMAL(3,2)) AS DECIMAL(24,2)) AS impaired
  FROM adjust),
ecl_full AS (
  SELECT *, CASE stage WHEN 1 THEN ecl_12m WHEN 3 THEN impaired ELSE ecl_lifetime END AS recognised FROM ecl)"""
)



def _sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {BASE}{',' + ctes if ctes else ''}\n{body}"


# --- scenarios: one row per (scenario, borrower) ----------------------------

_CRE = "commercial real estate"


def _scenario_sql(scenarios: list[tuple[str, str, int, str]], extra: str = "") -> str:
    """``stress(scenario, entity_id, sector, base_rating, rating, ead, base_ead)`` by brute force.

    Each scenario is (key, notches SQL over e, haircut add, exposure SQL over l and e).
    """
    parts, rows = [], []
    for i, (_, _, add, amount) in enumerate(scenarios):
        parts.append(
            f"""
sl{i} AS (SELECT l.borrower, l.maturity, CAST({amount} AS DECIMAL(18,2)) AS amount
  FROM active l JOIN entities e ON e.entity_id = l.borrower),"""
            + _net(f"sn{i}", add, "amount", f"sl{i}")
        )
    for i, (key, notches, _, _) in enumerate(scenarios):
        rows.append(
            f"""SELECT '{key}' AS scenario, x.entity_id, e.sector, e.rating AS base_rating, x.ead, b.ead AS base_ead,
    CASE WHEN rr.pos IS NULL THEN e.rating ELSE (['AAA','AA','A','BBB','BB','B','CCC'])[LEAST(7, rr.pos + ({notches}))] END AS rating
  FROM sn{i} x JOIN entities e ON e.entity_id = x.entity_id JOIN net b ON b.entity_id = x.entity_id
  LEFT JOIN rates rr ON rr.rating = e.rating"""
        )
    return (
        DEDICATED
        + ","
        + _net("net")
        + ","
        + RATES
        + ","
        + ",".join(parts)
        + ",\nstress AS ("
        + "\n  UNION ALL ".join(rows)
        + f"""),
stressed AS (
  SELECT s.*, s.ead * {PD} * {LGD} AS el, s.ead * {RW} AS rwa,
    s.base_ead * COALESCE(b.pd, CAST(0.0100 AS DECIMAL(5,4))) * {LGD} AS base_el
  FROM stress s LEFT JOIN rates r ON r.rating = s.rating LEFT JOIN rates b ON b.rating = s.base_rating),
totals AS (
  SELECT scenario, SUM(ead) AS total_ead, SUM(el) AS total_el, SUM(rwa) AS total_rwa FROM stressed GROUP BY scenario)"""
        + extra
    )


NAMED = [
    ("base", "0", 0, "l.amount"),
    ("nbfi_downgrade", "CASE WHEN e.counterparty_type = 'nbfi' THEN 2 ELSE 0 END", 0, "l.amount"),
    ("broad_downgrade", "1", 0, "l.amount"),
    ("haircut_plus20", "0", 20, "l.amount"),
    (
        "cre_downturn",
        f"CASE WHEN e.sector = '{_CRE}' THEN 1 ELSE 0 END",
        0,
        f"CASE WHEN e.sector = '{_CRE}' THEN floor(l.amount * CAST(1.25 AS DECIMAL(3,2))) ELSE l.amount END",
    ),
]
_MACRO = {
    "property_crash": {_CRE: 4, "energy": 1, "financial services": 1, "industrials": 1, "consumer": 1},
    "rates_shock": {_CRE: 1, "energy": 1, "financial services": 3, "industrials": 0, "consumer": 0},
    "recession": {_CRE: 2, "energy": 3, "financial services": 2, "industrials": 2, "consumer": 1},
    "stagflation": {_CRE: 3, "energy": 2, "financial services": 4, "industrials": 1, "consumer": 1},
}


def _macro_case(key: str) -> str:
    whens = " ".join(f"WHEN '{s}' THEN {n}" for s, n in _MACRO[key].items())
    return f"CASE e.sector {whens} ELSE 0 END"


MACRO = [("base", "0", 0, "l.amount")] + [(k, _macro_case(k), 0, "l.amount") for k in _MACRO]
NOTCHES = "notches AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS scenario, e.sector, {_macro_case(k)} AS notches, COUNT(*) AS names FROM entities e GROUP BY e.sector"
    for k in _MACRO
) + ")"
GRID = (
    [("base", "0", 0, "l.amount")]
    + [(f"downgrade:{n}", str(n), 0, "l.amount") for n in range(1, 7)]
    + [
        (f"exposure:{n}", "0", 0, f"floor(l.amount * CAST({1 + n / 10:.1f} AS DECIMAL(2,1)))")
        for n in range(1, 7)
    ]
)


def _bands(key: str, amount: str) -> str:
    """Watchlist counts of one exposure scenario, by brute force."""
    name = "b_" + key.replace(":", "_")
    return (
        f"{name}_l AS (SELECT l.loan_id, l.borrower, CAST({amount} AS DECIMAL(18,2)) AS amount"
        " FROM active l JOIN entities e ON e.entity_id = l.borrower),"
        + _connected(f"{name}_c", f"{name}_l")
        + f""",
{name} AS (
  SELECT '{key}' AS scenario,
    COUNT(*) FILTER (WHERE COALESCE(c.connected, 0) >= x.cap) AS red,
    COUNT(*) FILTER (WHERE COALESCE(c.connected, 0) < x.cap
      AND COALESCE(c.connected, 0) >= x.cap * CAST(0.75 AS DECIMAL(3,2))) AS amber
  FROM limits x LEFT JOIN {name}_c c ON c.head = x.entity_id)"""
    )


def _capital(rwa: str) -> str:
    return f"(CAST({rwa} AS DECIMAL(30,6)) * CAST(0.08 AS DECIMAL(3,2)))"


def _pct(rwa: str) -> str:
    return f"{_d(_capital(rwa))} / {_d('100000000')}"


def _snapshot_ctes() -> str:
    shares = []
    for key, notches, _, amount in NAMED:
        shares.append(
            f"""SELECT '{key}' AS scenario, COALESCE(CASE WHEN rr.pos IS NULL THEN e.rating
      ELSE (['AAA','AA','A','BBB','BB','B','CCC'])[LEAST(7, rr.pos + ({notches}))] END, 'unrated') AS bucket,
    o.{ 'cre' if key == 'cre_downturn' else 'amount'} AS amount
  FROM owners2 o JOIN entities e ON e.entity_id = o.owner LEFT JOIN rates rr ON rr.rating = e.rating"""
        )
    cre = NAMED[-1][3].replace("l.amount", "o.amount")
    return (
        ","
        + OWNERS
        + f""",
owners2 AS (SELECT o.owner, o.amount, CAST({cre} AS DECIMAL(18,2)) AS cre
  FROM owners o JOIN entities e ON e.entity_id = o.borrower),
buckets AS (SELECT scenario, bucket, SUM(amount) AS exposure FROM ({' UNION ALL '.join(shares)}) GROUP BY 1, 2),
best AS (
  SELECT scenario, arg_max(bucket, exposure) AS top_rating,
    CAST(MAX(exposure) AS DOUBLE) / CAST(SUM(exposure) AS DOUBLE) AS top_share FROM buckets GROUP BY scenario),
"""
        + _bands("base", "l.amount")
        + ","
        + _bands("cre_downturn", NAMED[-1][3])
        + """,
bands AS (
  SELECT k.scenario, b.red, b.amber FROM (VALUES ('base'), ('nbfi_downgrade'), ('broad_downgrade'),
    ('haircut_plus20')) k(scenario), b_base b
  UNION ALL SELECT scenario, red, amber FROM b_cre_downturn),
snap AS (
  SELECT t.*, x.top_rating, x.top_share, b.red, b.amber FROM totals t JOIN best x USING (scenario) JOIN bands b USING (scenario))"""
    )


def _grid_ctes() -> str:
    bands = [_bands("base", "l.amount")] + [
        _bands(k, a) for k, _, _, a in GRID if k.startswith("exposure")
    ]
    downs = ", ".join(f"('downgrade:{n}')" for n in range(1, 7))
    ups = " UNION ALL ".join(f"SELECT scenario, red FROM b_exposure_{n}" for n in range(1, 7))
    return (
        ",\n"
        + ",".join(bands)
        + f""",
reds AS (SELECT scenario, red FROM b_base UNION ALL {ups}
  UNION ALL SELECT k.s, b.red FROM (VALUES {downs}) k(s), b_base b),
wide AS (
  SELECT split_part(t.scenario, ':', 1) AS family,
    CASE WHEN t.scenario = 'base' THEN 0 ELSE CAST(split_part(t.scenario, ':', 2) AS BIGINT) END AS severity,
    CAST(t.total_el AS DOUBLE) AS el, {_d(_capital('t.total_rwa'))} AS cap, {_pct('t.total_rwa')} AS pct,
    CAST(r.red AS DOUBLE) AS red
  FROM totals t JOIN reds r ON r.scenario = t.scenario),
grid AS (
  SELECT family, severity, 'expected_loss' AS metric, el AS value FROM wide
  UNION ALL SELECT family, severity, 'capital', cap FROM wide
  UNION ALL SELECT family, severity, 'capital_pct_eligible', pct FROM wide
  UNION ALL SELECT family, severity, 'limit_breaches', red FROM wide)"""
    )


# --- faulty import source ---------------------------------------------------

FAULTY = """
f_e AS (
  SELECT CAST(entity_id AS VARCHAR) AS id,
    CASE WHEN entity_id % 97 = 0 THEN 'alien' ELSE counterparty_type END AS kind,
    CASE WHEN entity_id % 101 = 0 THEN '' ELSE sector END AS sector FROM entities),
f_n0 AS (
  SELECT loan_id AS k, CAST(loan_id AS VARCHAR) AS id, CAST(lender AS VARCHAR) AS lender,
    CASE WHEN loan_id % 83 = 0 THEN 'X' ELSE '' END || CAST(borrower AS VARCHAR) AS borrower,
    CASE WHEN loan_id % 103 = 0 THEN '12x' WHEN loan_id % 89 = 0 THEN '-5' ELSE CAST(amount AS VARCHAR) END AS amount,
    CASE WHEN loan_id % 79 = 0 THEN 'pending' ELSE status END AS status FROM loans),
f_n AS (
  SELECT * FROM f_n0 UNION ALL SELECT k, id, lender, borrower, '7', status FROM f_n0 WHERE k % 211 = 0
  UNION ALL SELECT * FROM f_n0 WHERE k % 223 = 0),
f_g0 AS (
  SELECT g.guarantee_id AS k, CAST(g.guarantee_id AS VARCHAR) AS id,
    CASE WHEN g.guarantee_id % 73 = 0 THEN 'X' ELSE '' END || CAST(g.loan_id AS VARCHAR) AS loan,
    CASE WHEN g.guarantee_id % 71 = 0 THEN 'X' ELSE '' END || CAST(g.guarantor AS VARCHAR) AS guarantor,
    CASE WHEN g.guarantee_id % 67 = 0 THEN '0' ELSE CAST(g.amount AS VARCHAR) END AS amount FROM guarantees g),
f_g AS (
  SELECT g.k, g.id, g.loan, g.amount,
    CASE WHEN g.k % 61 = 0 THEN COALESCE(n.borrower, g.guarantor) ELSE g.guarantor END AS guarantor
  FROM f_g0 g LEFT JOIN f_n0 n ON n.id = g.loan),
f_c AS (
  SELECT CAST(p.item AS VARCHAR) AS id,
    CASE WHEN p.item % 59 = 0 THEN 'X' ELSE '' END || CAST(i.pledged AS VARCHAR) AS pledged,
    CASE WHEN p.loan_id % 53 = 0 THEN 'X' ELSE '' END || CAST(p.loan_id AS VARCHAR) AS loan,
    CASE WHEN p.item % 43 = 0 THEN 'X0' ELSE CAST(i.issuer AS VARCHAR) END AS issuer,
    i.value, p.item % 47 = 0 AS bad_cut FROM pairs p JOIN items i ON i.item = p.item),
f_x AS (
  SELECT CASE WHEN eid LIKE '%1' THEN '' ELSE lid END AS id, eid, cap FROM (
    SELECT CAST(limit_id AS VARCHAR) AS lid,
      CASE WHEN limit_id % 37 = 0 THEN 'X' ELSE '' END || CAST(entity_id AS VARCHAR) AS eid,
      CASE WHEN limit_id % 41 = 0 THEN '0' ELSE CAST(cap AS VARCHAR) END AS cap FROM limits)),
f_eids AS (SELECT DISTINCT id FROM f_e), f_nids AS (SELECT DISTINCT id FROM f_n),
hits AS (
""" + "\n  UNION ".join(
    f"SELECT {t} AS tab, id, {m} AS reason FROM ({q})"
    for t, m, q in [
        ("'entities'", f"'{V.TYPE}'", "SELECT id FROM f_e WHERE kind NOT IN ('bank','corporate','nbfi','government')"),
        ("'entities'", f"'{V.SECTOR}'", "SELECT id FROM f_e WHERE sector = ''"),
        ("'loans'", f"'{V.BORROWER}'", "SELECT id FROM f_n WHERE borrower NOT IN (SELECT id FROM f_eids)"),
        ("'loans'", f"'{V.LENDER}'", "SELECT id FROM f_n WHERE lender NOT IN (SELECT id FROM f_eids)"),
        ("'loans'", f"'{V.PRINCIPAL}'", "SELECT id FROM f_n WHERE amount IN ('12x', '-5') UNION SELECT id FROM f_n GROUP BY id HAVING COUNT(DISTINCT CASE WHEN amount = '7' THEN '7.00' ELSE amount END) > 1"),
        ("'loans'", f"'{V.STATUS}'", "SELECT id FROM f_n WHERE status = 'pending'"),
        ("'guarantees'", f"'{V.GUARANTOR}'", "SELECT id FROM f_g WHERE guarantor NOT IN (SELECT id FROM f_eids)"),
        ("'guarantees'", f"'{V.GUARANTEED_LOAN}'", "SELECT id FROM f_g WHERE loan NOT IN (SELECT id FROM f_nids)"),
        ("'guarantees'", f"'{V.GUARANTEED_AMOUNT}'", "SELECT id FROM f_g WHERE amount = '0'"),
        ("'guarantees'", "'" + V.TWO_PARTIES.replace("'", "''") + "'", "SELECT g.id FROM f_g g JOIN f_n n ON n.id = g.loan AND n.borrower = g.guarantor"),
        ("'collateral'", f"'{V.PLEDGER}'", "SELECT id FROM f_c WHERE pledged NOT IN (SELECT id FROM f_eids)"),
        ("'collateral'", f"'{V.SECURED_LOAN}'", "SELECT id FROM f_c WHERE loan NOT IN (SELECT id FROM f_nids)"),
        ("'collateral'", f"'{V.ISSUER}'", "SELECT id FROM f_c WHERE issuer IS NOT NULL AND issuer NOT IN (SELECT id FROM f_eids)"),
        ("'collateral'", f"'{V.VALUE}'", "SELECT id FROM f_c WHERE value IS NOT NULL AND value <= 0"),
        ("'collateral'", f"'{V.HAIRCUT}'", "SELECT id FROM f_c WHERE value IS NOT NULL AND bad_cut"),
        ("'limits'", f"'{V.LIMIT_AMOUNT}'", "SELECT id FROM f_x WHERE cap = '0' AND id <> ''"),
        ("'limits'", f"'{V.LIMIT_ENTITY}'", "SELECT id FROM f_x WHERE eid NOT IN (SELECT id FROM f_eids) AND id <> ''"),
    ]
) + """),
records AS (
  SELECT 'entities' AS tab, id FROM f_e UNION SELECT 'loans', id FROM f_n UNION SELECT 'guarantees', id FROM f_g
  UNION SELECT 'collateral', id FROM f_c UNION SELECT 'limits', id FROM f_x WHERE id <> ''),
report AS (
  SELECT r.tab, r.id AS record_id, COUNT(h.reason) = 0 AS accepted,
    COALESCE(string_agg(h.reason, '; ' ORDER BY h.reason), '') AS reasons
  FROM records r LEFT JOIN hits h ON h.tab = r.tab AND h.id = r.id GROUP BY r.tab, r.id
  UNION ALL SELECT 'limits', '(blank)', FALSE, 'missing id' FROM f_x WHERE id = '')"""

# --- change batches ---------------------------------------------------------

CHANGES = """
asked AS (
  SELECT 2 * loan_id AS change_id,
    CASE WHEN loan_id % 75 = 0 THEN 'no such ' ELSE '' END || CAST(loan_id AS VARCHAR) AS subject_id,
    CASE WHEN loan_id % 125 = 0 THEN 'lender' ELSE 'principalAmount' END AS field,
    CASE WHEN loan_id % 175 = 0 THEN -1 ELSE CAST(floor(amount * CAST(1.1 AS DECIMAL(2,1))) AS BIGINT) END AS new_amount,
    'group_risk' AS role FROM loans
  UNION ALL
  SELECT 2 * limit_id + 1, CASE WHEN limit_id % 27 = 0 THEN '99999999999' ELSE CAST(limit_id AS VARCHAR) END,
    'limitAmount', CAST(floor(cap / 2) AS BIGINT),
    CASE WHEN limit_id % 6 = 0 THEN 'relationship_manager' ELSE 'group_risk' END FROM limits),
gated AS (SELECT *, NOT (field = 'limitAmount' AND role <> 'group_risk') AS allowed FROM asked),
judged AS (
  SELECT change_id, subject_id, field, new_amount,
    CASE WHEN subject_id LIKE '% %' OR field = 'lender' THEN 'invalid subject id, predicate, or amount'
      WHEN field = 'limitAmount' AND subject_id NOT IN (SELECT CAST(limit_id AS VARCHAR) FROM limits) THEN 'not found'
      WHEN field = 'principalAmount' AND subject_id NOT IN (SELECT CAST(loan_id AS VARCHAR) FROM loans) THEN 'not found'
      WHEN new_amount <= 0 THEN CASE field WHEN 'limitAmount' THEN 'limitAmount must be a positive decimal.'
        ELSE 'principalAmount must be a positive decimal.' END
      ELSE 'updated' END AS reason FROM gated WHERE allowed),
new_loans AS (
  SELECT l.loan_id, l.borrower, COALESCE(CAST(j.new_amount AS DECIMAL(18,2)), l.amount) AS amount, l.status, l.maturity
  FROM loans l LEFT JOIN judged j ON j.reason = 'updated' AND j.field = 'principalAmount'
    AND j.subject_id = CAST(l.loan_id AS VARCHAR)),
new_active AS (SELECT * FROM new_loans WHERE status = 'active'),
new_limits AS (
  SELECT x.limit_id, x.entity_id, COALESCE(CAST(j.new_amount AS DECIMAL(18,2)), x.cap) AS cap
  FROM limits x LEFT JOIN judged j ON j.reason = 'updated' AND j.field = 'limitAmount'
    AND j.subject_id = CAST(x.limit_id AS VARCHAR))"""
OFF = """
wanted AS (
  SELECT CAST(loan_id AS VARCHAR) AS subject_id, 'loan' AS kind FROM loans WHERE maturity <= 3
  UNION ALL
  SELECT CASE WHEN guarantee_id % 180 = 0 THEN 'bad id ' ELSE '' END || CAST(guarantee_id AS VARCHAR), 'guaranty'
    FROM guarantees WHERE amount > 250000
  UNION ALL
  SELECT CAST(CASE WHEN entity_id % 150 = 0 THEN entity_id + 1000000000 ELSE entity_id END AS VARCHAR), 'entity'
    FROM entities WHERE entity_id >= 0),
in_use AS (
  SELECT CAST(borrower AS VARCHAR) AS id FROM active UNION SELECT CAST(lender AS VARCHAR) FROM active
  UNION SELECT CAST(guarantor AS VARCHAR) FROM guarantees),
off AS (
  SELECT subject_id, kind,
    CASE WHEN subject_id LIKE '% %' THEN 'invalid subject id'
      WHEN kind = 'entity' AND subject_id NOT IN (SELECT CAST(entity_id AS VARCHAR) FROM entities) THEN 'not found'
      WHEN kind = 'entity' AND subject_id IN (SELECT id FROM in_use)
        THEN 'entity still referenced by an active loan or guaranty; deactivate those first'
      ELSE 'status set to ' || CASE kind WHEN 'loan' THEN 'closed' ELSE 'inactive' END
        || ' (excluded from metrics; history preserved)' END AS reason FROM wanted)"""
CREATES = """
p_loans AS (
  SELECT loan_id + 1000000000 AS id, CASE WHEN loan_id % 150 = 0 THEN -7 ELSE borrower END AS borrower,
    CASE WHEN loan_id % 250 = 0 THEN 0 ELSE amount END AS amount FROM loans),
p_given AS (
  SELECT loan_id + 2000000000 AS id, borrower + CASE WHEN loan_id % 300 = 0 THEN 0 ELSE 1 END AS guarantor,
    loan_id + 1000000000 AS loan FROM loans),
created AS (
  SELECT 'loans' AS tab, id, concat_ws('; ',
    CASE WHEN borrower NOT IN (SELECT entity_id FROM entities) THEN 'A loan must reference an existing borrower legal entity.' END,
    CASE WHEN amount <= 0 THEN 'principalAmount must be a positive decimal.' END) AS reasons FROM p_loans
  UNION ALL
  SELECT 'guarantees', g.id, concat_ws('; ',
    CASE WHEN g.guarantor NOT IN (SELECT entity_id FROM entities) THEN 'A guaranty must reference an existing guarantor legal entity.' END,
    CASE WHEN g.guarantor = l.borrower THEN 'Guarantor must differ from the guaranteed loan''s borrower (two distinct entities).' END)
  FROM p_given g JOIN p_loans l ON l.id = g.loan)"""


def _totals_sql(loans: str, guarantees: str, limits: str) -> str:
    def pair(table: str, old: str, new: str, amount: str, new_amount: str) -> str:
        return (
            f"SELECT '{table}' AS \"table\", {_b(f'(SELECT COUNT(*) FROM {old})')} AS rows_before,"
            f" {_d(f'(SELECT SUM({amount}) FROM {old})')} AS before,"
            f" {_b(f'(SELECT COUNT(*) FROM {new})')} AS rows_after,"
            f" {_d(f'(SELECT SUM({new_amount}) FROM {new})')} AS after"
        )

    return " UNION ALL ".join(
        [
            pair("loans", "active", loans, "amount", "amount"),
            pair("guarantees", "guarantees", guarantees, "amount", "amount"),
            pair("limits", "limits", limits, "cap", "cap"),
        ]
    )


def _breakdown(heads: str) -> str:
    return f"""
SELECT a.head, '1. Direct loan' AS contribution_type, l.borrower AS counterparty, {_d('l.amount')} AS amount,
  CAST(l.loan_id AS VARCHAR) AS via, e.entity_name AS counterparty_name,
  'Loan ' || l.loan_id AS via_detail, NULL AS outside_loan
FROM {heads} h JOIN anc a ON a.head = h.head JOIN active l ON l.borrower = a.member JOIN entities e ON e.entity_id = l.borrower
UNION ALL
SELECT a.head, '2. Guaranty (contingent)', l.borrower, {_d('g.amount')}, CAST(g.guarantee_id AS VARCHAR), e.entity_name, 'Guaranty ' || g.guarantee_id, CAST(l.loan_id AS VARCHAR)
FROM {heads} h JOIN anc a ON a.head = h.head JOIN guarantees g ON g.guarantor = a.member
JOIN active l ON l.loan_id = g.loan_id JOIN entities e ON e.entity_id = l.borrower
WHERE NOT EXISTS (SELECT 1 FROM anc b WHERE b.member = l.borrower AND b.head = a.head)
UNION ALL
SELECT s.head, '3. Shared collateral', s.borrower, {_d('s.amount')}, CAST(s.item AS VARCHAR), e.entity_name, 'Item ' || s.item, CAST(s.loan_id AS VARCHAR) FROM (
  SELECT DISTINCT a.head, l.borrower, l.loan_id, l.amount, p1.item
  FROM {heads} h JOIN anc a ON a.head = h.head JOIN active l1 ON l1.borrower = a.member
  JOIN pairs p1 ON p1.loan_id = l1.loan_id JOIN pairs p2 ON p2.item = p1.item JOIN active l ON l.loan_id = p2.loan_id
  WHERE NOT EXISTS (SELECT 1 FROM anc b WHERE b.member = l.borrower AND b.head = a.head)) s
JOIN entities e ON e.entity_id = s.borrower"""


NBFI = """
nb AS (SELECT entity_id AS nbfi FROM entities WHERE counterparty_type = 'nbfi'),
nb_rows AS (
  SELECT b.nbfi, '1. direct' AS contribution_type, l.borrower AS counterparty, l.amount, CAST(l.loan_id AS VARCHAR) AS via, l.loan_id AS src
  FROM nb b JOIN active l ON l.borrower = b.nbfi
  UNION ALL
  SELECT b.nbfi, '2. guarantee cascade', l.borrower, g.amount, CAST(g.guarantee_id AS VARCHAR), g.guarantee_id
  FROM nb b JOIN guarantees g ON g.guarantor = b.nbfi JOIN loans l ON l.loan_id = g.loan_id
  UNION ALL
  SELECT DISTINCT b.nbfi, '3. shared collateral', l.borrower, l.amount, CAST(p1.item AS VARCHAR), l.loan_id
  FROM nb b JOIN loans l1 ON l1.borrower = b.nbfi JOIN pairs p1 ON p1.loan_id = l1.loan_id
  JOIN pairs p2 ON p2.item = p1.item JOIN active l ON l.loan_id = p2.loan_id WHERE l.borrower <> b.nbfi),
top_nb AS (SELECT DISTINCT nbfi FROM nb_rows)"""

WWR = """
wwr AS (
  SELECT l.loan_id, l.borrower, p.item AS collateral, i.issuer, bu.ubo AS grp, iu.ubo AS issuer_ubo
  FROM pairs p JOIN items i ON i.item = p.item JOIN active l ON l.loan_id = p.loan_id
  JOIN ubo bu ON bu.entity_id = l.borrower JOIN ubo iu ON iu.entity_id = i.issuer)"""


def _shares(attribute: str, default: str) -> str:
    return f"""
SELECT COALESCE(e.{attribute}, '{default}') AS bucket, {_d('SUM(v.exposure)')} AS exposure,
  round({_d('SUM(v.exposure)')} / (SELECT {_d('SUM(amount)')} FROM active), 6) AS share
FROM vec v JOIN entities e ON e.entity_id = v.owner GROUP BY 1"""


def _headline(ctes: str) -> str:
    return _sql(
        ctes,
        f"""SELECT t.head, {_d('COALESCE(c.own, 0)')} AS direct_head_only, {_d('COALESCE(c.direct, 0)')} AS direct_group,
  {_d('COALESCE(c.connected, 0)')} AS connected, {_d('COALESCE(x.cap, 0)')} AS group_limit,
  COALESCE(c.connected, 0) > COALESCE(x.cap, 0) AS limit_breached,
  {_d('COALESCE(c.connected, 0) - COALESCE(c.own, 0)')} AS hidden
FROM tops t LEFT JOIN conn c ON c.head = t.head LEFT JOIN limits x ON x.entity_id = t.head""",
    )


def _watch(where: str) -> str:
    return _sql(
        WATCH,
        f"""SELECT entity_id, entity_name, limit_id, {_d('connected')} AS connected, {_d('cap')} AS limit_amount,
  round({_ratio('connected', 'cap')}, 6) AS utilisation, band FROM watch {where}""",
    )


_UBO_ROWS = """FROM watch w JOIN ubo u ON u.entity_id = w.entity_id"""

_TRIPLES = """
t_ns AS (SELECT 'https://example.org/credit/terms/' AS t, 'https://example.org/credit/id/' AS i),
iri_rows AS (
  SELECT 'type' AS p, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS pi, entity_id AS s, 'https://www.omg.org/spec/Commons/Organizations/LegalEntity' AS o FROM entities
  UNION ALL SELECT 'type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', loan_id, 'https://spec.edmcouncil.org/fibo/ontology/LOAN/LoansGeneral/Loans/Loan' FROM loans
  UNION ALL SELECT 'type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', guarantee_id, 'https://spec.edmcouncil.org/fibo/ontology/FBC/DebtAndEquities/Guaranty/Guaranty' FROM guarantees
  UNION ALL SELECT 'type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', item, 'https://spec.edmcouncil.org/fibo/ontology/FBC/DebtAndEquities/Debt/Collateral' FROM items
  UNION ALL SELECT 'type', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', limit_id, t || 'Limit' FROM limits, t_ns
  UNION ALL SELECT p, t || p, s, i || CAST(o AS VARCHAR) FROM t_ns, (
    SELECT 'isSubsidiaryOf' AS p, entity_id AS s, parent AS o FROM entities WHERE parent IS NOT NULL
    UNION ALL SELECT 'lender', loan_id, lender FROM loans UNION ALL SELECT 'borrower', loan_id, borrower FROM loans
    UNION ALL SELECT 'guarantor', guarantee_id, guarantor FROM guarantees
    UNION ALL SELECT 'guaranteedLoan', guarantee_id, loan_id FROM guarantees
    UNION ALL SELECT 'pledgedBy', item, pledged FROM items
    UNION ALL SELECT 'collateralIssuer', item, issuer FROM items WHERE issuer IS NOT NULL
    UNION ALL SELECT 'securesLoan', item, loan_id FROM pairs UNION ALL SELECT 'hasLimit', entity_id, limit_id FROM limits)),
text_rows AS (
  SELECT 'label' AS p, 'http://www.w3.org/2000/01/rdf-schema#label' AS pi, s, o FROM (
    SELECT entity_id AS s, entity_name AS o FROM entities UNION ALL SELECT loan_id, 'Loan ' || loan_id FROM loans
    UNION ALL SELECT guarantee_id, 'Guaranty ' || guarantee_id FROM guarantees
    UNION ALL SELECT item, 'Item ' || item FROM items UNION ALL SELECT limit_id, 'Limit ' || limit_id FROM limits)
  UNION ALL SELECT 'source', 'http://purl.org/dc/terms/source', s, o FROM (
    SELECT entity_id AS s, 'entities.csv' AS o FROM entities UNION ALL SELECT loan_id, 'loans.csv' FROM loans
    UNION ALL SELECT guarantee_id, 'guarantees.csv' FROM guarantees UNION ALL SELECT item, 'collateral.csv' FROM items
    UNION ALL SELECT limit_id, 'limits.csv' FROM limits)
  UNION ALL SELECT p, t || p, s, o FROM t_ns, (
    SELECT 'sector' AS p, entity_id AS s, sector AS o FROM entities
    UNION ALL SELECT 'counterpartyType', entity_id, counterparty_type FROM entities
    UNION ALL SELECT 'country', entity_id, country FROM entities
    UNION ALL SELECT 'rating', entity_id, rating FROM entities WHERE rating IS NOT NULL
    UNION ALL SELECT 'currency', loan_id, 'SGD' FROM loans UNION ALL SELECT 'currency', guarantee_id, 'SGD' FROM guarantees
    UNION ALL SELECT 'currency', limit_id, 'SGD' FROM limits
    UNION ALL SELECT 'status', loan_id, status FROM loans UNION ALL SELECT 'status', entity_id, 'active' FROM entities
    UNION ALL SELECT 'status', guarantee_id, 'active' FROM guarantees UNION ALL SELECT 'status', item, 'active' FROM items
    UNION ALL SELECT 'status', limit_id, 'active' FROM limits)),
number_rows AS (
  SELECT p, t || p AS pi, s, CASE WHEN o LIKE '%.%' THEN rtrim(rtrim(o, '0'), '.') ELSE o END AS o FROM t_ns, (
    SELECT 'eligibleCapital' AS p, entity_id AS s, CAST(capital AS VARCHAR) AS o FROM entities WHERE capital IS NOT NULL
    UNION ALL SELECT 'annualRevenue', entity_id, CAST(revenue AS VARCHAR) FROM entities WHERE revenue IS NOT NULL
    UNION ALL SELECT 'principalAmount', loan_id, CAST(amount AS VARCHAR) FROM loans
    UNION ALL SELECT 'maturityYears', loan_id, CAST(maturity AS VARCHAR) FROM loans
    UNION ALL SELECT 'guaranteedAmount', guarantee_id, CAST(amount AS VARCHAR) FROM guarantees
    UNION ALL SELECT 'collateralValue', item, CAST(value AS VARCHAR) FROM items WHERE value IS NOT NULL
    UNION ALL SELECT 'haircut', item, CAST(CAST(haircut AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS VARCHAR) FROM items WHERE value IS NOT NULL
    UNION ALL SELECT 'limitAmount', limit_id, CAST(cap AS VARCHAR) FROM limits)),
all_rows AS (
  SELECT DISTINCT p, s, o, 2 + length(pi) + length(i) + length(CAST(s AS VARCHAR)) + 8 + add + length(o) - 2 AS chars FROM (
    SELECT p, pi, s, o, 2 AS add FROM iri_rows UNION ALL SELECT p, pi, s, o, 2 FROM text_rows
    UNION ALL SELECT p, pi, s, o, 2 + 4 + length('http://www.w3.org/2001/XMLSchema#decimal') FROM number_rows), t_ns)"""


_ROUNDS = """
d0 AS MATERIALIZED (SELECT ubo AS seed, entity_id FROM ubo WHERE ubo IN (SELECT head FROM tops)),
pledge AS MATERIALIZED (SELECT pledged AS entity_id, CAST(SUM(COALESCE(value, 0)) AS DECIMAL(30,2)) AS value FROM items GROUP BY pledged),
owed AS MATERIALIZED (SELECT l.borrower, g.guarantor, CAST(SUM(g.amount) AS DECIMAL(30,2)) AS amount FROM guarantees g JOIN loans l ON l.loan_id = g.loan_id GROUP BY 1, 2),
takedown AS MATERIALIZED (SELECT ubo AS guarantor, entity_id AS member FROM ubo UNION SELECT entity_id, entity_id FROM entities),
nets AS MATERIALIZED (SELECT entity_id, CAST(ead AS DECIMAL(22,4)) AS net FROM net),
st(seed, r, cut, grew, members) AS (
  SELECT seed, 0, CAST(0 AS DOUBLE), true, list(entity_id) FROM d0 GROUP BY seed
  UNION ALL
  (WITH m AS (SELECT seed, unnest(members) AS e FROM st WHERE grew),
  c AS (SELECT m.seed, LEAST(0.5, CAST(0.5 AS DOUBLE) * CAST(COALESCE(SUM(k.value), 0) AS DOUBLE) / (SELECT CAST(SUM(value) AS DOUBLE) FROM pledge)) AS cut
    FROM m LEFT JOIN pledge k ON k.entity_id = m.e GROUP BY m.seed),
  o AS (SELECT m.seed, w.guarantor, SUM(w.amount) AS amount FROM m JOIN owed w ON w.borrower = m.e GROUP BY 1, 2),
  f AS (SELECT o.seed, o.guarantor FROM o JOIN c ON c.seed = o.seed LEFT JOIN nets n ON n.entity_id = o.guarantor
    WHERE o.amount > CAST(round(CAST(0.3 AS DOUBLE) * (1 - c.cut), 12) AS DECIMAL(13,12)) * COALESCE(n.net, 0)),
  a AS (SELECT DISTINCT f.seed, t.member FROM f JOIN takedown t ON t.guarantor = f.guarantor
    LEFT JOIN m g ON g.seed = f.seed AND g.e = f.guarantor LEFT JOIN m x ON x.seed = f.seed AND x.e = t.member
    WHERE g.e IS NULL AND x.e IS NULL),
  n AS (SELECT seed, list(member) AS more FROM a GROUP BY seed)
  SELECT s.seed, s.r + 1, c.cut, n.more IS NOT NULL, list_concat(s.members, COALESCE(n.more, []))
  FROM st s JOIN c ON c.seed = s.seed LEFT JOIN n ON n.seed = s.seed WHERE s.grew)),
fin AS MATERIALIZED (SELECT seed, MAX(r) AS r, arg_max(cut, r) AS cut, arg_max(members, r) AS members FROM st GROUP BY seed),
dl AS MATERIALIZED (SELECT seed, unnest(members) AS entity_id FROM fin),
losses AS (
  SELECT d.seed, SUM(l.amount) AS amount FROM dl d JOIN active l ON l.borrower = d.entity_id
  WHERE NOT EXISTS (SELECT 1 FROM guarantees g WHERE g.loan_id = l.loan_id
    AND NOT EXISTS (SELECT 1 FROM dl x WHERE x.seed = d.seed AND x.entity_id = g.guarantor)) GROUP BY d.seed)"""


def oracle_sql() -> dict[str, str]:
    """Name -> statement, for every registered query SQL can restate."""
    q: dict[str, str] = {}

    # sources
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {_b('COUNT(*)')} AS rows FROM {r}"
        for t, r in [("entities", "entities"), ("loans", "loans"), ("guarantees", "guarantees"),
                     ("collateral", "pairs"), ("limits", "limits")]
    )
    q["book_load_counts"] = _sql("", counts)
    q["csv_round_trip"] = _sql(
        "", f"SELECT c.*, CASE WHEN c.\"table\" = 'loans' THEN (SELECT {_d('SUM(amount)')} FROM loans) END AS amount FROM ({counts}) c"
    )
    q["store_reload"] = _sql(
        "",
        f"SELECT c.*, 'calm' AS dataset FROM ({counts}) c UNION ALL SELECT \"table\", CASE WHEN \"table\" = 'loans' THEN "
        f"(SELECT {_b('COUNT(*)')} FROM active) ELSE rows END, 'stressed' FROM ({counts}) d",
    )
    q["guarded_import_strict"] = _sql("", f"SELECT *, true AS clean_loaded, false AS faulty_loaded FROM ({counts})")
    q["collateral_items"] = _sql(
        "",
        f"""SELECT item AS collateral_id, 'Item ' || item AS collateral_type, pledged AS pledged_by_entity_id,
  issuer AS issuer_entity_id, {_d('value')} AS collateral_value, {_b('haircut')} AS haircut_pct, 'active' AS status,
  {_b('n_rows')} AS n_rows FROM items""",
    )
    q["triples_by_predicate"] = _sql(
        _TRIPLES.replace("2 + length(pi) + length(i) + length(CAST(s AS VARCHAR)) + 8 + add + length(o) - 2",
                         "length('<') + length(i) + length(CAST(s AS VARCHAR)) + length('> <') + length(pi) + length('> ') + add + length(o) + length(' .')"),
        "SELECT CASE p WHEN 'type' THEN '22-rdf-syntax-ns#type' WHEN 'label' THEN 'rdf-schema#label' ELSE p END AS predicate, "
        f"{_b('COUNT(*)')} AS triples, {_b('SUM(chars)')} AS chars FROM all_rows GROUP BY 1",
    )
    q["mapped_orders"] = f"""SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, 'B0' AS lender_entity_id,
  CAST(o_custkey AS VARCHAR) AS borrower_entity_id, {_d('CAST(o_totalprice AS DECIMAL(18,2))')} AS exposure_amount,
  'SGD' AS currency, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'active' END AS status, {_b('3')} AS maturity_years FROM orders"""

    # filters
    q["filtered_expected_loss"] = _sql(
        CREDIT,
        f"SELECT entity_id, rating, sector, {_d('ead')} AS ead, {_c('el')} AS el FROM credit "
        "WHERE rating IN ('BB', 'B', 'CCC', 'unrated') AND ead >= 100000",
    )
    q["red_watchlist"] = _sql(WATCH, f"SELECT entity_id, {_d('connected')} AS connected FROM watch WHERE band = 'red'")
    q["wwr_flagged_watchlist"] = _sql(
        WATCH + "," + WWR,
        f"SELECT entity_id, {_d('connected')} AS connected, band FROM watch WHERE entity_id IN "
        "(SELECT borrower FROM wwr WHERE grp = issuer_ubo)",
    )

    # ownership
    q["ultimate_parents"] = _sql("", "SELECT entity_id, ubo FROM ubo")
    q["ownership_closure"] = _sql("", f"SELECT member, head, {_b('depth')} AS depth FROM anc")
    q["group_heads"] = _sql("", "SELECT head, entity_name AS head_name FROM tops")
    q["group_sizes"] = _sql("", f"SELECT head, {_b('COUNT(*)')} AS members FROM anc GROUP BY head")
    q["ownership_cycles"] = _sql(
        """
edges AS (
  SELECT e.entity_id, COALESCE(e.parent, CASE WHEN e.entity_id > 0 AND e.entity_id % 8 = 4 THEN c.entity_id END) AS parent
  FROM entities e LEFT JOIN entities c ON c.entity_id = 4 * e.entity_id + 1),
reach(member, stop, depth) AS (
  SELECT entity_id, parent, 1 FROM edges WHERE parent IS NOT NULL
  UNION ALL SELECT r.member, e.parent, r.depth + 1 FROM reach r JOIN edges e ON e.entity_id = r.stop
    WHERE e.parent IS NOT NULL AND r.depth < 40),
on_cycle AS (SELECT DISTINCT member FROM reach WHERE member = stop)""",
        """SELECT r.member AS entity_id, arg_min(r.stop, r.depth) AS revisited_entity_id, FALSE AS on_cycle
FROM reach r JOIN on_cycle c ON c.member = r.stop WHERE r.member NOT IN (SELECT member FROM on_cycle) GROUP BY r.member
UNION ALL SELECT member, member, TRUE FROM on_cycle""",
    )

    # exposure
    q["direct_exposure"] = _sql(OWNERS, f"SELECT name AS entity_id, {_d('exposure')} AS exposure_amount FROM direct")
    q["direct_vector"] = _sql(OWNERS, f"SELECT name, {_d('exposure')} AS exposure_amount FROM direct WHERE name NOT IN (SELECT lender FROM loans)")
    q["connected_exposure"] = _sql(
        CONNECTED,
        f"""SELECT head, {_d('own')} AS direct_head_only, {_d('direct')} AS direct, {_d('given')} AS guarantees_given,
  {_d('shared')} AS shared_collateral, {_d('connected')} AS connected FROM conn
UNION ALL SELECT head, 0, 0, 0, 0, 0 FROM (
  SELECT DISTINCT a.head FROM pairs p JOIN active l ON l.loan_id = p.loan_id JOIN anc a ON a.member = l.borrower
  WHERE FALSE)""",
    )
    q["connected_vector"] = _sql(
        CONNECTED, f"SELECT t.head AS name, {_d('COALESCE(c.connected, 0)')} AS exposure FROM tops t LEFT JOIN conn c ON c.head = t.head"
    )
    q["headline"] = _headline(CONNECTED)
    q["headline_active_loans"] = _headline(CONNECTED)
    q["headline_any_status"] = _headline(_connected("conn", "loans", inside_too=True))
    q["breakdown_breaching_names"] = _sql(WATCH, _breakdown("top_watch"))
    q["exposure_to_groups"] = _sql(
        WATCH, f"SELECT t.head, {_d('COALESCE(c.connected, 0)')} AS connected FROM tops t LEFT JOIN conn c ON c.head = t.head"
    )
    q["nbfi_cascade_totals"] = _sql(
        NBFI,
        f"SELECT nbfi, contribution_type, {_d('SUM(amount)')} AS amount, {_b('COUNT(*)')} AS paths FROM nb_rows GROUP BY nbfi, contribution_type",
    )
    q["nbfi_cascade"] = _sql(
        NBFI,
        f"""SELECT DISTINCT r.nbfi, r.contribution_type, r.counterparty, {_d('r.amount')} AS amount, r.via, e.entity_name AS counterparty_name
FROM nb_rows r JOIN top_nb t ON t.nbfi = r.nbfi JOIN entities e ON e.entity_id = r.counterparty""",
    )
    q["risk_owners"] = _sql(OWNERS, f"SELECT loan_id, owner, {_d('amount')} AS exposure FROM owners")
    q["attributed_exposure"] = _sql(
        OWNERS,
        f"SELECT v.owner, e.entity_name AS owner_name, e.sector, {_d('v.exposure')} AS exposure FROM vec v JOIN entities e ON e.entity_id = v.owner",
    )
    q["top_counterparties"] = _sql(
        OWNERS,
        f"SELECT v.owner, e.entity_name AS owner_name, {_d('v.exposure')} AS exposure FROM vec v JOIN entities e ON e.entity_id = v.owner ORDER BY v.exposure DESC, v.owner LIMIT 10",
    )
    q["guarantee_chains"] = _sql(
        "",
        f"""SELECT s.head, s.guarantee_id, s.guarantor AS guarantor_entity_id, s.borrower AS borrower_entity_id, {_d('s.amount')} AS amount,
  ge.entity_name AS guarantor_name, be.entity_name AS borrower_name FROM (
  SELECT a.head, g.guarantee_id, g.guarantor, l.borrower, g.amount FROM guarantees g JOIN loans l ON l.loan_id = g.loan_id JOIN anc a ON a.member = g.guarantor
  UNION SELECT a.head, g.guarantee_id, g.guarantor, l.borrower, g.amount FROM guarantees g JOIN loans l ON l.loan_id = g.loan_id JOIN anc a ON a.member = l.borrower) s
JOIN entities ge ON ge.entity_id = s.guarantor JOIN entities be ON be.entity_id = s.borrower""",
    )

    # concentration
    q["hhi"] = _sql(
        OWNERS,
        """SELECT round((SELECT SUM(CAST(exposure AS DOUBLE) * CAST(exposure AS DOUBLE)) / (CAST(SUM(exposure) AS DOUBLE) * CAST(SUM(exposure) AS DOUBLE)) FROM direct), 8) AS direct_hhi,
  round((SELECT SUM(CAST(exposure AS DOUBLE) * CAST(exposure AS DOUBLE)) / (CAST(SUM(exposure) AS DOUBLE) * CAST(SUM(exposure) AS DOUBLE)) FROM vec), 8) AS connected_hhi""",
    )
    ten = "(SELECT CAST(SUM(exposure) AS DOUBLE) FROM (SELECT exposure FROM {v} ORDER BY exposure DESC LIMIT 10)) / (SELECT CAST(SUM(exposure) AS DOUBLE) FROM {v})"
    q["cr10"] = _sql(
        OWNERS, f"SELECT round({ten.format(v='direct')}, 6) AS direct_cr, round({ten.format(v='vec')}, 6) AS connected_cr"
    )
    q["sector_shares"] = _sql(OWNERS, _shares("sector", ""))
    q["country_shares"] = _sql(OWNERS, _shares("country", "unknown"))
    q["rating_shares"] = _sql(OWNERS, _shares("rating", "unrated"))
    total = "(SELECT CAST(SUM(amount) AS DOUBLE) FROM active)"
    q["sub_investment_grade_share"] = _sql(
        OWNERS,
        f"SELECT round(CAST(SUM(v.exposure) AS DOUBLE) / {total}, 6) AS sub_investment_grade_share FROM vec v JOIN entities e ON e.entity_id = v.owner WHERE e.rating IN ('BB', 'B', 'CCC')",
    )
    q["top_sector"] = _sql(
        OWNERS,
        f"SELECT e.sector AS bucket, round(CAST(SUM(v.exposure) AS DOUBLE) / {total}, 6) AS share FROM vec v JOIN entities e ON e.entity_id = v.owner GROUP BY e.sector ORDER BY SUM(v.exposure) DESC, e.sector LIMIT 1",
    )
    q["government_share"] = _sql(
        OWNERS,
        f"SELECT {_d('SUM(v.exposure)')} AS exposure, round(CAST(SUM(v.exposure) AS DOUBLE) / {total}, 6) AS share FROM vec v JOIN entities e ON e.entity_id = v.owner WHERE e.counterparty_type = 'government'",
    )
    q["threshold_flags"] = _sql(
        OWNERS
        + f""",
vals AS (
  SELECT 'direct HHI' AS metric, 'book' AS key, (SELECT SUM(CAST(exposure AS DOUBLE) * CAST(exposure AS DOUBLE)) / (CAST(SUM(exposure) AS DOUBLE) * CAST(SUM(exposure) AS DOUBLE)) FROM direct) AS value
  UNION ALL SELECT 'connected HHI', 'book', (SELECT SUM(CAST(exposure AS DOUBLE) * CAST(exposure AS DOUBLE)) / (CAST(SUM(exposure) AS DOUBLE) * CAST(SUM(exposure) AS DOUBLE)) FROM vec)
  UNION ALL SELECT 'direct CR10', 'book', {ten.format(v='direct')}
  UNION ALL SELECT 'connected CR10', 'book', {ten.format(v='vec')}
  UNION ALL SELECT 'sector share', e.sector, CAST(SUM(v.exposure) AS DOUBLE) / {total} FROM vec v JOIN entities e ON e.entity_id = v.owner GROUP BY e.sector),
levels AS (
  SELECT metric, key, value, CASE
    WHEN metric LIKE '%HHI' THEN CASE WHEN value > 0.18 THEN 'high' ELSE 'normal' END
    WHEN metric = 'sector share' THEN CASE WHEN value > 0.30 THEN 'high' ELSE 'normal' END
    WHEN value > 0.60 THEN 'high' WHEN value >= 0.50 THEN 'elevated' WHEN value >= 0.30 THEN 'normal' ELSE 'low' END AS level FROM vals)""",
        "SELECT metric, key, round(value, 6) AS value, level, level = 'high' AS flagged FROM levels",
    )

    # limits
    q["watchlist"] = _watch("")
    q["limit_breaches"] = _watch("WHERE band = 'red'")
    q["near_limit"] = _watch("WHERE connected >= cap * CAST(0.5 AS DECIMAL(2,1))")
    q["band_counts"] = _sql(
        WATCH,
        ", ".join(f"{_b(f'COUNT(*) FILTER (WHERE band = {chr(39)}{b}{chr(39)})')} AS {b}" for b in ("red", "amber", "green")).join(["SELECT ", " FROM watch"]),
    )
    q["ubo_aggregation"] = _sql(
        WATCH,
        f"""SELECT u.ubo, w.entity_id, w.entity_name, w.entity_id = u.ubo AS is_ubo, {_d('w.connected')} AS connected,
  {_d('w.cap')} AS limit_amount, round({_ratio('w.connected', 'w.cap')}, 6) AS utilisation, w.band {_UBO_ROWS}""",
    )
    q["subsidiary_breach_check"] = _sql(
        WATCH,
        f"""SELECT u.ubo AS head, {_d('COALESCE(MAX(h.connected), 0)')} AS ubo_connected, {_d('MAX(x.cap)')} AS ubo_limit,
  {_b('COUNT(*) FILTER (WHERE u.entity_id <> u.ubo)')} AS subsidiaries,
  {_b('COUNT(*) FILTER (WHERE u.entity_id <> u.ubo AND w.connected >= w.cap)')} AS subsidiary_breaches,
  COALESCE(COALESCE(MAX(h.connected), 0) > MAX(x.cap), FALSE) AS ubo_breaches
FROM ubo u LEFT JOIN watch w ON w.entity_id = u.entity_id LEFT JOIN conn h ON h.head = u.ubo LEFT JOIN limits x ON x.entity_id = u.ubo
GROUP BY u.ubo HAVING COUNT(*) FILTER (WHERE u.entity_id <> u.ubo) > 0""",
    )
    q["breaching_subsidiaries"] = _sql(
        WATCH,
        f"SELECT u.ubo AS head, w.entity_id, {_d('w.connected')} AS connected, {_d('w.cap')} AS limit_amount {_UBO_ROWS} WHERE w.entity_id <> u.ubo AND w.connected >= w.cap",
    )
    q["pre_deal_check"] = _sql(
        CONNECTED
        + ","
        + RATES
        + """,
deal AS (
  SELECT l.loan_id AS deal_id, l.borrower AS borrower_id, u.ubo, COALESCE(e.rating, 'unrated') AS rating, l.amount,
    l.loan_id % 10 + 1 AS tenor, CAST(COALESCE(c.connected, 0) AS DECIMAL(18,2)) AS now,
    CAST(COALESCE(x.cap, y.cap, 0) AS DECIMAL(18,2)) AS base,
    CAST(COALESCE(x.cap, y.cap, 0) * COALESCE(r.factor, CAST(1.00 AS DECIMAL(3,2))) AS DECIMAL(24,4)) AS eff
  FROM loans l JOIN ubo u ON u.entity_id = l.borrower JOIN entities e ON e.entity_id = u.ubo
  LEFT JOIN conn c ON c.head = u.ubo LEFT JOIN limits x ON x.entity_id = u.ubo LEFT JOIN limits y ON y.entity_id = l.borrower
  LEFT JOIN rates r ON r.rating = e.rating WHERE l.status = 'closed'),
deals AS (
  SELECT *, CAST(now + amount AS DECIMAL(18,2)) AS post, CAST(eff * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(28,6)) AS settle FROM deal)""",
        f"""SELECT deal_id, borrower_id, ubo, rating, {_d('amount')} AS amount, {_b('tenor')} AS tenor, {_d('now')} AS connected_now,
  {_d('base')} AS base_limit, {_d('eff')} AS effective_limit, {_d('post')} AS connected_post, {_d('eff - post')} AS headroom,
  post <= eff AS limit_ok, {_b('7')} AS tenor_cap, tenor <= 7 AS tenor_ok, {_c('settle')} AS settlement_limit, amount <= settle AS settlement_ok,
  post <= eff AND tenor <= 7 AND amount <= settle AS ok,
  concat_ws('; ', CASE WHEN post > eff THEN 'connected limit: post-deal ' || post || ' > ' || eff END,
    CASE WHEN tenor > 7 THEN 'tenor ' || tenor || 'y exceeds the 7y cap' END,
    CASE WHEN amount > settle THEN 'deal ' || amount || ' exceeds the settlement sub-limit ' || settle END) AS reasons
FROM deals""",
    )
    q["limit_basis_utilisation"] = _sql(
        CONNECTED,
        f"""SELECT t.head AS name, {_d('COALESCE(c.connected, 0)')} AS exposure, round({_d('COALESCE(c.connected, 0)')} / 100000000, 6) AS of_capital,
  round({_d('COALESCE(c.connected, 0)')} / NULLIF({_d('e.revenue')}, 0), 6) AS of_revenue,
  {_d('COALESCE(c.connected, 0)')} / 100000000 > 0.25 AS over_capital_basis,
  COALESCE({_d('COALESCE(c.connected, 0)')} / NULLIF({_d('e.revenue')}, 0) > 0.10, FALSE) AS over_revenue_basis
FROM tops t JOIN entities e ON e.entity_id = t.head LEFT JOIN conn c ON c.head = t.head""",
    )

    # mitigation and credit risk
    net = DEDICATED + "," + _net("net")
    q["eligible_collateral"] = _sql(net, f"SELECT entity_id, {_d('mitigant')} AS mitigant_0 FROM net_m")
    q["net_exposure"] = _sql(
        net, f"SELECT entity_id, {_d('gross')} AS gross, {_d('mitigant')} AS mitigant, {_d('ead')} AS net FROM net"
    )
    q["collateralised_names"] = _sql(
        net,
        f"SELECT x.entity_id, e.entity_name, e.sector, {_d('x.gross')} AS gross, {_d('x.mitigant')} AS mitigant, {_d('x.ead')} AS net FROM net x JOIN entities e ON e.entity_id = x.entity_id WHERE x.mitigant > 0",
    )
    q["credit_risk"] = _sql(
        CREDIT,
        f"""SELECT entity_id, entity_name, sector, rating, {_d('ead')} AS ead, {_d('pd')} AS pd, CAST(0.45 AS DOUBLE) AS lgd,
  {_c('el')} AS el, {_c('rwa')} AS rwa, {_c(_capital('rwa'))} AS capital FROM credit""",
    )
    q["portfolio_summary"] = _sql(
        CREDIT,
        f"""SELECT {_d('SUM(ead)')} AS total_ead, {_c('SUM(el)')} AS total_el, {_c('SUM(rwa)')} AS total_rwa,
  {_c(_capital('SUM(rwa)'))} AS total_capital, round({_pct('SUM(rwa)')}, 6) AS capital_pct_eligible FROM credit""",
    )

    # provisioning and valuation
    q["counterparty_ecl"] = _sql(
        CURVE,
        f"""SELECT entity_id, rating, {_b('stage')} AS stage, {_d('ead')} AS ead, {_d('ecl_12m')} AS ecl_12m, {_d('ecl_lifetime')} AS ecl_lifetime,
  {_d('recognised')} AS ecl_recognised, round({_ratio('recognised', 'ead')}, 6) AS coverage FROM ecl_full""",
    )
    q["staging_summary"] = _sql(
        CURVE,
        f"""SELECT s.stage, {_b('COUNT(e.entity_id)')} AS names, {_d('COALESCE(SUM(e.ead), 0)')} AS ead, {_d('COALESCE(SUM(e.recognised), 0)')} AS ecl
FROM (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS stage) s LEFT JOIN ecl_full e ON e.stage = s.stage GROUP BY s.stage""",
    )
    q["total_ecl"] = _sql(CURVE, f"SELECT {_d('SUM(recognised)')} AS total_ecl FROM ecl_full")
    q["exposure_profiles"] = _sql(
        CURVE, f"SELECT entity_id, {_b('t')} AS t, {_d('CAST(CAST(ee AS DECIMAL(28,8)) AS DECIMAL(24,4))')} AS ee, {_d('CAST(CAST(ee + half AS DECIMAL(28,8)) AS DECIMAL(24,4))')} AS pfe FROM points"
    )
    q["counterparty_xva"] = _sql(
        CURVE,
        f"""SELECT entity_id, rating, {_c('ead')} AS ead, {_b('tenor')} AS maturity, {_d('CAST(CAST(peak AS DECIMAL(24,6)) AS DECIMAL(24,2))')} AS peak_pfe, {_d('CAST(CAST(epe AS DECIMAL(24,6)) AS DECIMAL(24,2))')} AS epe, {_d('cva')} AS cva FROM adjust""",
    )
    q["total_cva"] = _sql(CURVE, f"SELECT {_d('SUM(cva)')} AS total_cva FROM adjust")
    parts = ", ".join(f"{_d(c)} AS {c}" for c in ("cva", "dva", "fva", "mva", "kva"))
    q["xva_breakdown"] = _sql(
        CURVE, f"SELECT entity_id, rating, {parts}, {_d('cva - dva + fva + mva + kva')} AS total_xva FROM adjust"
    )
    sums = ", ".join(f"{_d(f'SUM({c})')} AS {c}" for c in ("cva", "dva", "fva", "mva", "kva"))
    q["xva_totals"] = _sql(CURVE, f"SELECT {sums}, {_d('SUM(cva - dva + fva + mva + kva)')} AS total_xva FROM adjust")

    # stress
    scale = "['AAA','AA','A','BBB','BB','B','CCC']"
    q["rating_downgrades"] = _sql(
        RATES,
        "SELECT e.entity_id, e.rating, "
        + ", ".join(f"CASE WHEN r.pos IS NOT NULL THEN ({scale})[LEAST(7, r.pos + {n})] END AS down_{n}" for n in (1, 2, 6))
        + " FROM entities e LEFT JOIN rates r ON r.rating = e.rating",
    )
    snap = _scenario_sql(NAMED, _snapshot_ctes())
    q["scenario_snapshots"] = _sql(
        snap,
        f"""SELECT scenario, {_d('total_ead')} AS total_ead, {_c('total_el')} AS total_el, {_c('total_rwa')} AS total_rwa,
  {_c(_capital('total_rwa'))} AS total_capital, round({_pct('total_rwa')}, 6) AS capital_pct_eligible, top_rating,
  round(top_share, 6) AS top_rating_share, {_b('red')} AS watchlist_red, {_b('amber')} AS watchlist_amber FROM snap""",
    )
    q["scenario_compare"] = _sql(
        snap,
        f"""SELECT s.scenario, {_d('s.total_ead')} AS total_ead, {_d('b.total_ead')} AS total_ead_base, {_c('s.total_el')} AS total_el, {_c('b.total_el')} AS total_el_base,
  round({_pct('s.total_rwa')}, 6) AS capital_pct_eligible, round({_pct('b.total_rwa')}, 6) AS capital_pct_eligible_base,
  {_b('s.red')} AS watchlist_red, {_b('b.red')} AS watchlist_red_base
FROM snap s JOIN snap b ON b.scenario = 'base' WHERE s.scenario <> 'base'""",
    )
    q["expected_loss_deltas"] = _sql(
        _scenario_sql(NAMED),
        f"""SELECT scenario, entity_id, COALESCE(base_rating, 'unrated') AS rating_base, COALESCE(rating, 'unrated') AS rating_shocked,
  {_c('base_el')} AS el_base, {_c('el')} AS el_shocked, {_c('el - base_el')} AS el_delta FROM stressed WHERE scenario <> 'base'""",
    )
    q["macro_notches"] = _sql(NOTCHES, f"SELECT scenario, sector, {_b('notches')} AS notches, {_b('names')} AS names FROM notches")
    macro = _scenario_sql(MACRO) + ",\n" + NOTCHES
    q["macro_compare"] = _sql(
        macro,
        f"""SELECT t.scenario, {_c('t.total_el')} AS total_el, {_c(_capital('t.total_rwa'))} AS total_capital, round({_pct('t.total_rwa')}, 6) AS capital_pct_eligible,
  {_b('COALESCE(n.hit, 0)')} AS names_downgraded, {_b('COALESCE(n.total, 0)')} AS total_notches
FROM totals t LEFT JOIN (SELECT scenario, SUM(CASE WHEN notches > 0 THEN names ELSE 0 END) AS hit, SUM(notches * names) AS total FROM notches GROUP BY scenario) n ON n.scenario = t.scenario""",
    )
    q["macro_sector_impacts"] = _sql(
        macro,
        f"""SELECT s.scenario, s.sector, {_b('MAX(n.notches)')} AS notches, {_c('SUM(s.base_el)')} AS el_base, {_c('SUM(s.el)')} AS el_shocked,
  {_c('SUM(s.el) - SUM(s.base_el)')} AS el_delta
FROM stressed s JOIN notches n ON n.scenario = s.scenario AND n.sector = s.sector WHERE s.scenario <> 'base' GROUP BY s.scenario, s.sector""",
    )
    grid = _scenario_sql(GRID, _grid_ctes())
    q["severity_grid"] = _sql(grid, f"SELECT family, {_b('severity')} AS severity, metric, round(value, 2) AS value FROM grid")
    q["reverse_stress"] = _sql(
        grid
        + """,
goals AS (
  SELECT g.metric, CASE WHEN g.metric = 'limit_breaches' THEN 'exposure' ELSE 'downgrade' END AS family, g.value AS base, m.x * g.value AS target
  FROM grid g, (SELECT unnest([CAST(1.0 AS DOUBLE), 1.25, 1.5, 2.0, 4.0, 1.3]) AS x) m
  WHERE g.family = 'base' AND (m.x <> 1.3 OR g.metric = 'capital')),
found AS (
  SELECT o.metric, o.family, o.target, o.base, MIN(CASE WHEN g.value >= o.target THEN g.severity END) AS severity,
    arg_min(g.value, g.severity) FILTER (WHERE g.value >= o.target) AS hit, MAX(CASE WHEN g.severity = 6 THEN g.value END) AS worst
  FROM goals o JOIN grid g ON g.metric = o.metric AND g.family = o.family GROUP BY o.metric, o.family, o.target, o.base)""",
        f"""SELECT metric, family, round(target, 2) AS target, round(base, 2) AS base_value, {_b('severity')} AS severity,
  round(COALESCE(hit, worst), 2) AS achieved, severity IS NOT NULL AS feasible, {_b('6')} AS searched_to,
  CASE WHEN severity IS NULL THEN 'not reachable within the search cap' WHEN family = 'exposure' THEN '+' || (severity * 10) || '% exposure uplift'
    WHEN severity = 1 THEN 'broad downgrade −1 notch' ELSE 'broad downgrade −' || severity || ' notches' END AS shock_label FROM found""",
    )

    # contagion and wrong-way risk
    q["default_cascade"] = _sql(
        """
grp AS (SELECT ubo AS seed, entity_id FROM ubo WHERE ubo IN (SELECT head FROM tops)),
sizes AS (SELECT seed, COUNT(*) AS n FROM grp GROUP BY seed),
hit AS (
  SELECT g.seed, SUM(l.amount) AS amount FROM grp g JOIN active l ON l.borrower = g.entity_id
  WHERE NOT EXISTS (SELECT 1 FROM guarantees x WHERE x.loan_id = l.loan_id
    AND x.guarantor NOT IN (SELECT m.entity_id FROM grp m WHERE m.seed = g.seed)) GROUP BY g.seed),
lost AS (
  SELECT seed, SUM(amount) AS amount FROM (
    SELECT DISTINCT g.seed, l.loan_id, l.amount FROM guarantees x JOIN grp g ON g.entity_id = x.guarantor JOIN active l ON l.loan_id = x.loan_id
    JOIN ubo bu ON bu.entity_id = l.borrower WHERE bu.ubo <> g.seed) GROUP BY seed),
loss AS (
  SELECT s.seed, s.n, COALESCE(h.amount, 0) * CAST(0.45 AS DECIMAL(3,2)) AS d, COALESCE(o.amount, 0) * CAST(0.45 AS DECIMAL(3,2)) AS c
  FROM sizes s LEFT JOIN hit h ON h.seed = s.seed LEFT JOIN lost o ON o.seed = s.seed)""",
        f"""SELECT seed, {_b('n')} AS group_size, {_d('CAST(d AS DECIMAL(18,4))')} AS direct_loss, {_d('CAST(c AS DECIMAL(18,4))')} AS contagion_loss,
  {_d('CAST(d + c AS DECIMAL(18,4))')} AS total_loss, round({_ratio('CAST(d + c AS DECIMAL(18,4))', 'CAST(d AS DECIMAL(18,4))')}, 6) AS amplification FROM loss""",
    )
    q["solvent_guaranteed_loans"] = _sql(
        "",
        """SELECT DISTINCT bu.ubo AS seed, g.loan_id FROM guarantees g JOIN loans l ON l.loan_id = g.loan_id
JOIN ubo bu ON bu.entity_id = l.borrower JOIN ubo gu ON gu.entity_id = g.guarantor WHERE gu.ubo <> bu.ubo""",
    )
    q["default_cascade_multiround"] = _sql(
        DEDICATED + "," + _net("net") + "," + _ROUNDS,
        f"""SELECT s.head AS seed, {_b('d.r')} AS rounds, {_b('len(d.members)')} AS defaulted, {_b('len(d.members) - i.n')} AS second_order,
  round(LEAST(1.0, CAST(0.45 AS DOUBLE) + d.cut) * {_d('COALESCE(x.amount, 0)')}, 2) AS total_loss, round(round(d.cut, 3), 2) AS firesale_haircut,
  true AS converged
FROM tops s JOIN fin d ON d.seed = s.head JOIN (SELECT seed, COUNT(*) AS n FROM d0 GROUP BY seed) i ON i.seed = s.head
LEFT JOIN losses x ON x.seed = s.head""",
    )
    q["structural_wrong_way_risk"] = _sql(
        WWR,
        """SELECT w.issuer, w.borrower, w.loan_id, w.collateral, w.grp AS "group", be.entity_name AS borrower_name, ie.entity_name AS issuer_name
FROM wwr w JOIN entities be ON be.entity_id = w.borrower JOIN entities ie ON ie.entity_id = w.issuer WHERE w.grp = w.issuer_ubo""",
    )
    q["general_wrong_way_risk"] = _sql(
        WWR,
        """SELECT w.loan_id, w.borrower, w.collateral, w.issuer, CASE WHEN be.sector = ie.sector THEN 'sector' ELSE 'country' END AS driver
FROM wwr w JOIN entities be ON be.entity_id = w.borrower JOIN entities ie ON ie.entity_id = w.issuer
WHERE w.grp <> w.issuer_ubo AND (be.sector = ie.sector OR be.country = ie.country)""",
    )

    # validation, changes, audit
    q["import_report"] = _sql(FAULTY, 'SELECT tab AS "table", record_id, accepted, reasons FROM report')
    q["import_totals"] = (
        f"SELECT {_b('COUNT(*) FILTER (WHERE accepted)')} AS accepted, {_b('COUNT(*) FILTER (WHERE NOT accepted)')} AS rejected, "
        f"{_b('COUNT(*)')} AS total FROM ({q['import_report']})"
    )
    q["import_rejections"] = _sql(
        FAULTY,
        f"""SELECT tab AS "table", reason, {_b('COUNT(*)')} AS records FROM hits GROUP BY tab, reason
UNION ALL SELECT 'limits', 'missing id', {_b('COUNT(*)')} FROM f_x WHERE id = ''""",
    )
    q["duplicate_keys"] = _sql(
        FAULTY,
        f"""SELECT 'loans' AS "table", id AS record_id, {_b('COUNT(*)')} AS rows FROM f_n GROUP BY id HAVING COUNT(DISTINCT amount) > 1""",
    )
    q["guarded_import"] = _sql(
        FAULTY,
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", {_b('COUNT(*)')} AS rows FROM {r} x WHERE x.id IN (SELECT record_id FROM report WHERE tab = '{t}' AND accepted)"
            for t, r in [("entities", "f_e"), ("loans", "f_n"), ("guarantees", "f_g"), ("collateral", "f_c"), ("limits", "f_x")]
        ),
    )
    q["create_outcomes"] = _sql(
        CREATES, "SELECT tab AS \"table\", CAST(id AS VARCHAR) AS record_id, reasons = '' AS accepted, reasons FROM created"
    )
    q["created_totals"] = _sql(
        CREATES
        + """,
after_loans AS (SELECT amount FROM active UNION ALL SELECT p.amount FROM p_loans p JOIN created c ON c.tab = 'loans' AND c.id = p.id WHERE c.reasons = ''),
after_given AS (SELECT amount FROM guarantees UNION ALL SELECT 1000 FROM created WHERE tab = 'guarantees' AND reasons = '')""",
        _totals_sql("after_loans", "after_given", "limits"),
    )
    q["amount_update_outcomes"] = _sql(
        CHANGES, "SELECT change_id, subject_id, field, reason = 'updated' AS accepted, reason FROM judged"
    )
    q["amount_update_totals"] = _sql(CHANGES, _totals_sql("new_active", "guarantees", "new_limits"))
    q["saved_changes"] = q["amount_update_totals"]
    q["deactivation_outcomes"] = _sql(
        OFF, "SELECT subject_id, kind, reason LIKE 'status set%' AS accepted, reason FROM off"
    )
    q["deactivation_totals"] = _sql(
        OFF
        + """,
left_loans AS (SELECT amount FROM active WHERE CAST(loan_id AS VARCHAR) NOT IN (SELECT subject_id FROM off WHERE kind = 'loan' AND reason LIKE 'status set%')),
left_given AS (SELECT amount FROM guarantees WHERE CAST(guarantee_id AS VARCHAR) NOT IN (SELECT subject_id FROM off WHERE kind = 'guaranty' AND reason LIKE 'status set%'))""",
        _totals_sql("left_loans", "left_given", "limits"),
    )
    q["change_flags"] = _sql(
        CONNECTED + "," + CHANGES + "," + _connected("newc", "new_active"),
        """SELECT 'limit-breach' AS flag, CAST(x.entity_id AS VARCHAR) AS subject FROM new_limits x JOIN newc c ON c.head = x.entity_id
WHERE c.connected >= x.cap AND x.cap > 0 AND x.entity_id NOT IN (
  SELECT o.entity_id FROM limits o JOIN conn p ON p.head = o.entity_id WHERE p.connected >= o.cap)""",
    )
    q["flag_records"] = _sql(
        WATCH + "," + WWR,
        """SELECT 'flag-limit-breach' AS action, CAST(entity_id AS VARCHAR) AS target, 'accepted' AS outcome,
  'connected ' || CAST(connected AS DECIMAL(30,2)) || ' >= limit ' || cap AS reason FROM watch WHERE band = 'red'
UNION ALL SELECT 'flag-wrong-way-risk', CAST(loan_id AS VARCHAR), 'accepted',
  'collateral ' || collateral || ' issued by same group ' || grp || ' as borrower' FROM wwr WHERE grp = issuer_ubo""",
    )
    q["approval_outcomes"] = _sql(
        """
pend AS (SELECT loan_id AS id, 'user' || (loan_id % 3) AS maker, CASE WHEN loan_id % 60 = 0 THEN 'approved' ELSE 'pending' END AS status FROM active),
dec AS (
  SELECT d.*, p.id AS pid, CASE WHEN p.id IS NULL OR p.status <> 'pending' THEN 'no such pending change'
    WHEN d.checker = p.maker THEN 'four-eyes: the checker must differ from the maker'
    WHEN d.role <> 'group_risk' THEN 'role ''' || d.role || ''' may not approve changes' END AS denial
  FROM (SELECT loan_id AS id, 'user' || (loan_id % 4) AS checker, CASE WHEN loan_id % 70 = 0 THEN 'relationship_manager' ELSE 'group_risk' END AS role,
    CASE WHEN loan_id % 80 = 0 THEN 'reject' ELSE 'approve' END AS decision FROM loans) d LEFT JOIN pend p ON p.id = d.id)""",
        """SELECT id, CASE WHEN pid IS NOT NULL THEN 'loan' END AS kind, CAST(id AS VARCHAR) AS subject_id, checker, decision, denial IS NULL AS accepted,
  COALESCE(denial, CASE decision WHEN 'reject' THEN 'rejected by checker' ELSE 'approved' END) AS reason FROM dec""",
    )
    q["audit_chain_problems"] = _sql(
        "",
        """SELECT loan_id AS seq, 'entry_hash mismatch (content altered)' AS problem FROM active WHERE loan_id % 97 = 0
UNION ALL SELECT a.loan_id, 'seq out of order' FROM active a WHERE a.loan_id > 0 AND a.loan_id - 1 NOT IN (SELECT loan_id FROM active)
UNION ALL SELECT a.loan_id, 'prev_hash does not chain' FROM active a WHERE a.loan_id > 0 AND (a.loan_id % 2 = 0 OR a.loan_id - 1 NOT IN (SELECT loan_id FROM active))""",
    )

    q["audit_log_in_order"] = _sql(
        "",
        """SELECT * FROM (WITH n AS (SELECT row_number() OVER (ORDER BY loan_id) - 1 AS s FROM active),
o AS (SELECT s, row_number() OVER (ORDER BY s + CASE WHEN s % 20 = 5 THEN 1.5 ELSE 0 END) - 1 AS "at",
  lag(s) OVER (ORDER BY s + CASE WHEN s % 20 = 5 THEN 1.5 ELSE 0 END) AS prev FROM n)
SELECT "at", s AS seq, 'entry_hash mismatch (content altered)' AS problem FROM o WHERE s % 97 = 0
UNION ALL SELECT "at", s, 'seq out of order' FROM o WHERE s <> "at"
UNION ALL SELECT "at", s, 'prev_hash does not chain' FROM o WHERE NOT CASE WHEN "at" = 0 THEN s % 2 = 0 ELSE s % 2 = 1 AND prev = s - 1 END)""",
    )

    # access
    q["group_access"] = _sql(
        "",
        """SELECT 'P' || e.entity_id AS principal, p.head, e.entity_id % 10 = 0 OR (e.entity_id % 10 <> 9 AND p.head IN (4 * e.entity_id, e.entity_id + 1)) AS allowed
FROM entities e, LATERAL (SELECT unnest([4 * e.entity_id, e.entity_id + 1, e.entity_id + 2]) AS head) p WHERE e.entity_id >= 0""",
    )
    q["group_grants"] = _sql(
        "",
        """SELECT DISTINCT 'P' || e.entity_id AS principal, p.head, FALSE AS sees_all
FROM entities e, LATERAL (SELECT unnest([4 * e.entity_id, e.entity_id + 1]) AS head) p
WHERE e.entity_id >= 0 AND e.entity_id % 10 NOT IN (0, 9) AND p.head IN (SELECT head FROM tops)
UNION ALL SELECT 'P' || entity_id, NULL, TRUE FROM entities WHERE entity_id >= 0 AND entity_id % 10 = 0""",
    )
    q["second_order_cascades"] = f"SELECT seed, second_order FROM ({q['default_cascade_multiround']}) WHERE second_order > 0"
    q["macro_hit_sectors"] = f"SELECT scenario, sector, notches FROM ({q['macro_notches']}) WHERE notches > 0"
    q["second_stage_names"] = f"SELECT entity_id, stage, ecl_recognised FROM ({q['counterparty_ecl']}) WHERE stage > 1"
    q["energy_valuation"] = _sql(
        CURVE, f"SELECT a.entity_id, {_d('a.cva')} AS cva FROM adjust a JOIN entities e ON e.entity_id = a.entity_id WHERE e.sector = 'energy' AND a.cva >= 1"
    )
    q["scoped_wrong_way"] = _sql(
        WATCH + "," + WWR,
        """SELECT loan_id, borrower, collateral, issuer FROM wwr JOIN ubo u ON u.entity_id = borrower WHERE grp = issuer_ubo
AND (u.ubo IN (SELECT entity_id FROM watch WHERE band = 'red') OR borrower IN (SELECT entity_id FROM watch WHERE band = 'red'))""",
    )
    grades = ", ".join(f"({i}, '{g}')" for i, g in enumerate(P.RATING_ORDER))
    q["macro_book_ratings"] = _sql(
        NOTCHES,
        f"""SELECT scenario, rating, {_b('COUNT(*)')} AS names FROM (
  SELECT n.scenario, CASE WHEN g.i IS NULL THEN e.rating ELSE h.grade END AS rating
  FROM entities e JOIN notches n ON n.sector IS NOT DISTINCT FROM e.sector
  LEFT JOIN (VALUES {grades}) g(i, grade) ON g.grade = e.rating
  LEFT JOIN (VALUES {grades}) h(i, grade) ON h.i = LEAST(g.i + n.notches, {len(P.RATING_ORDER) - 1})) GROUP BY scenario, rating""",
    )
    q["ownership_cycle_objects"] = q["ownership_cycles"].split("SELECT r.member AS entity_id, arg_min")[0] + f"""
, loops AS (SELECT r.member, MIN(r.stop) AS cycle_id, {_b('COUNT(DISTINCT r.stop)')} AS length FROM reach r JOIN on_cycle c ON c.member = r.member
  WHERE r.stop IN (SELECT member FROM on_cycle) GROUP BY r.member),
ins AS (SELECT r.member, arg_min(r.stop, r.depth) AS entry, MIN(r.depth) AS distance FROM reach r JOIN on_cycle c ON c.member = r.stop
  WHERE r.member NOT IN (SELECT member FROM on_cycle) GROUP BY r.member)
SELECT member AS entity_id, cycle_id, length, {_b('0')} AS distance, member AS entry FROM loops
UNION ALL SELECT i.member, l.cycle_id, l.length, {_b('i.distance')}, i.entry FROM ins i JOIN loops l ON l.member = i.entry"""
    for frame, whole in (("hhi", "hhi"), ("cr10", "cr10"), ("sectors", "sector_shares"), ("countries", "country_shares"), ("ratings", "rating_shares")):
        q[f"dashboard_{frame}"] = q[whole]
    q["group_view_contributions"] = q["breakdown_breaching_names"]
    q["amplifying_cascades"] = f"SELECT seed, contagion_loss FROM ({q['default_cascade']}) WHERE contagion_loss > 0"
    q["watchlist_of_nbfis"] = _sql(
        WATCH,
        f"""SELECT w.entity_id, {_d('w.connected')} AS connected, w.band FROM watch w JOIN entities e ON e.entity_id = w.entity_id
WHERE e.counterparty_type = 'nbfi'""",
    )
    q["scoped_watchlist"] = _sql(
        WATCH,
        f"""SELECT w.entity_id, w.entity_name, w.limit_id, {_d('w.connected')} AS connected, {_d('w.cap')} AS limit_amount,
  round({_ratio('w.connected', 'w.cap')}, 6) AS utilisation, w.band FROM watch w JOIN ubo u ON u.entity_id = w.entity_id
WHERE u.ubo IN (SELECT head FROM top_watch) OR w.entity_id IN (SELECT head FROM top_watch)""",
    )
    q["scoped_exposures"] = _sql(
        WATCH + "," + OWNERS,
        f"""SELECT v.owner, e.entity_name AS owner_name, e.sector, {_d('v.exposure')} AS exposure FROM vec v JOIN entities e ON e.entity_id = v.owner
WHERE v.owner IN (SELECT head FROM top_watch)""",
    )
    q["limit_edit_gate"] = _sql(
        CHANGES,
        "SELECT change_id, allowed, CASE WHEN NOT allowed THEN 'role ''' || role || ''' may not edit limits' END AS refusal FROM gated",
    )
    return q
