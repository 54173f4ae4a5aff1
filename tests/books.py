"""Small books for tests: two hand-checked variants and a generator of random ones."""

from __future__ import annotations

import random

from linkbook.book import Book
from linkbook.sources.csv_folder import to_book
from linkbook.sources.orders_book import staged
from linkbook.schema import COLUMNS, raw_schema

CRE, FIN, LOG = "commercial real estate", "financial services", "transport & logistics"
# The thirty entities behind the golden figures
# (id, type, sector, parent, country, rating).
ENTITIES = """
0099 bank F - SG AAA | 0001 corporate C - SG A | 0002 corporate C 0001 SG A
0003 corporate C 0001 SG BBB | 0004 corporate L 0002 MY BBB | 0010 corporate energy - SG BBB
0011 corporate energy 0010 SG BB | 0012 corporate energy 0010 MY BB | 0020 nbfi F - HK BB
0021 nbfi F 0020 HK BB | 0022 nbfi F 0020 HK B | 0023 nbfi F 0020 HK B
0030 nbfi F - SG BB | 0031 corporate C - SG BBB | 0032 corporate energy - MY BBB
0033 corporate industrials - ID BB | 0040 corporate C - SG BBB | 0041 corporate technology - SG A
0042 government government - SG AAA | 0043 corporate healthcare - SG BBB | 0044 corporate L - MY BB
0045 corporate consumer - SG BBB | 0046 nbfi F - SG BB | 0047 corporate industrials - ID B
0048 corporate consumer - SG BBB | 0049 corporate energy - MY BB | 0050 corporate consumer - SG BBB
0051 corporate industrials - MY BB | 0052 corporate healthcare - SG BBB | 0053 corporate consumer - ID B
"""
# Loan, borrower, millions (tenor is the millions, seven at most).
STRESSED_LOANS = """
1001 0002 5, 1002 0004 5, 1003 0001 5, 1004 0003 5, 1005 0045 7, 1006 0048 7, 1010 0030 5,
1011 0031 7, 1012 0032 7, 1013 0033 7, 1014 0047 7, 1015 0049 7, 1016 0043 7, 1017 0031 1,
1018 0032 1, 1019 0033 1, 1023 0047 1, 1020 0021 8, 1021 0022 8, 1022 0023 8, 1030 0011 7,
1031 0012 3, 1040 0040 3, 1041 0041 2, 1042 0042 3, 1044 0044 2, 1048 0046 2, 1050 0050 3,
1051 0051 3, 1052 0052 2, 1053 0053 2
"""
CALM_LOANS = """
1001 0002 3, 1002 0004 2, 1003 0001 2, 1004 0003 2, 1005 0045 4, 1006 0048 4, 1010 0030 4,
1011 0031 5, 1012 0032 4, 1013 0033 4, 1014 0047 4, 1015 0049 4, 1016 0043 4, 1020 0021 4,
1021 0022 4, 1022 0023 3, 1030 0011 5, 1031 0012 3, 1040 0040 5, 1041 0041 4, 1042 0042 5,
1044 0044 4, 1048 0046 4, 1050 0050 4, 1051 0051 4, 1052 0052 3, 1053 0053 3
"""
# Guarantee, guarantor, loan, millions.
STRESSED_GUARANTEES = "2001 0001 1005 7, " + ", ".join(
    f"{2002 + i} 0030 {1011 + i} 7" for i in range(6)
)
CALM_GUARANTEES = "2002 0030 1011 5"
# Item, pledged by, loan, issuer, millions, haircut.
STRESSED_ITEMS = """
3001 0002 1001 - 6 20, 3001 0002 1006 - 6 20, 3002 0011 1030 0010 4 50, 3003 0021 1020 - 5 20,
3004 0042 1042 - 2 5, 3005 0040 1040 0001 2 25, 3006 0043 1016 - 4 40, 3007 0030 1010 - 3 30
"""
CALM_ITEMS = """
3001 0002 1001 - 3 20, 3002 0011 1030 0042 4 10, 3003 0021 1020 - 3 20, 3004 0042 1042 - 3 5,
3005 0040 1040 0001 2 25
"""
LIMIT_25 = "0001 0030 0031 0032 0033 0040 0041 0042 0043 0044 0045 0046 0047 0048 0049 0050 0051 0052 0053"
OTHER_LIMITS = {"0010": 12, "0020": 20, "0021": 10, "0022": 10, "0023": 10}
MILLION = 1_000_000


def _le(x: str) -> str | None:
    return None if x == "-" else f"LE-{x}"


def _rows(text: str) -> list[list[str]]:
    return [part.split() for part in text.replace("\n", " ").split(",")]


def _variant(loans: str, guarantees: str, items: str) -> dict[str, list[tuple]]:
    sectors = {"C": CRE, "F": FIN, "L": LOG}
    entities = []
    for cell in ENTITIES.replace("\n", "|").split("|"):
        if cell.strip():
            i, kind, sector, parent, country, rating = cell.split()
            capital = "100000000" if i == "0099" else None
            entities.append(
                (f"LE-{i}", f"Entity {i}", kind, sectors.get(sector, sector), _le(parent), capital,
                 None, country, rating)
            )
    return {
        "entities": entities,
        "loans": [
            (f"LN-{i}", "LE-0099", _le(b), str(int(m) * MILLION), "SGD", "active", str(min(7, int(m))))
            for i, b, m in _rows(loans)
        ],
        "guarantees": [
            (f"GTY-{i}", _le(g), f"LN-{n}", str(int(m) * MILLION), "SGD")
            for i, g, n, m in _rows(guarantees)
        ],
        "collateral": [
            (f"COL-{i}", f"Item {i}", _le(p), f"LN-{n}", _le(s), str(int(m) * MILLION), h)
            for i, p, n, s, m, h in _rows(items)
        ],
        "limits": [
            (f"LIM-LE-{i}", f"LE-{i}", str(m * MILLION), "SGD")
            for i, m in {**{x: 25 for x in LIMIT_25.split()}, **OTHER_LIMITS}.items()
        ],
    }


def stressed_rows() -> dict[str, list[tuple]]:
    return _variant(STRESSED_LOANS, STRESSED_GUARANTEES, STRESSED_ITEMS)


def calm_rows() -> dict[str, list[tuple]]:
    return _variant(CALM_LOANS, CALM_GUARANTEES, CALM_ITEMS)


def raw_tables(spark, **rows):
    return {t: spark.createDataFrame(rows.get(t, []), raw_schema(t)) for t in COLUMNS}


def make_book(spark, **rows) -> Book:
    return staged(to_book(raw_tables(spark, **rows)))


def entity(i, parent=None, kind="corporate", sector="energy", rating="BBB", country="SG", capital=None):
    return (i, f"Name {i}", kind, sector, parent, capital, None, country, rating)


def loan(i, borrower, amount, status="active", lender="L", tenor="3"):
    return (i, lender, borrower, str(amount), "SGD", status, tenor)


def guarantee(i, by, loan_id, amount):
    return (i, by, loan_id, str(amount), "SGD")


def item(i, loan_id, pledged="E0", issuer=None, value=None, haircut=None):
    return (i, f"Item {i}", pledged, loan_id, issuer, None if value is None else str(value), haircut)


def random_rows(seed: int, entities: int = 30, loans: int = 60, packages: bool = True):
    """A random forest with hot borrowers, hot items, shared packages and closed loans."""
    rng = random.Random(seed)
    ratings = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC", None, "NR"]
    sectors = [CRE, FIN, "energy", "consumer", "unknown sector"]
    names = [f"E{i}" for i in range(entities)]
    es = [entity("L", None, "bank", FIN, "AAA", "SG", "50000000")]
    for i, n in enumerate(names):
        parent = None if i == 0 or rng.random() < 0.3 else names[rng.randrange(i) if rng.random() < 0.6 else 0]
        es.append(entity(n, parent, rng.choice(["corporate", "nbfi", "government"]),
                         rng.choice(sectors), rng.choice(ratings), rng.choice(["SG", "MY", None])))
    ls, gs, cs = [], [], []
    for i in range(loans):
        borrower = names[1] if rng.random() < 0.3 else rng.choice(names)
        status = "closed" if rng.random() < 0.2 else "active"
        ls.append(loan(f"N{i}", borrower, rng.randrange(1, 100) * 1000, status, tenor=str(rng.randrange(1, 9))))
        for j in range(rng.choice([0, 0, 1, 1, 2])):
            by = names[2] if rng.random() < 0.3 else rng.choice(names)
            if by != borrower:
                gs.append(guarantee(f"G{i}_{j}", by, f"N{i}", rng.randrange(1, 100) * 1000))
        chosen = set()
        if packages and rng.random() < 0.4:
            chosen |= {"C_HOT", "C_HOT2"}
        if rng.random() < 0.3:
            chosen.add("C_HOT")
        for _ in range(rng.choice([0, 1, 2])):
            chosen.add(f"C{rng.randrange(8)}")
        for c in chosen:
            cs.append((c, f"N{i}"))
    attrs = {c: (rng.choice(names), rng.choice([None, *names]), rng.choice([None, rng.randrange(1, 80) * 1000]),
                 str(rng.randrange(0, 101, 10))) for c in sorted({c for c, _ in cs})}
    items = [item(c, n, *attrs[c]) for c, n in cs]
    limits = [(f"LIM{i}", n, str(rng.choice([0, 50, 200, 800]) * 1000), "SGD")
              for i, n in enumerate(names) if rng.random() < 0.6]
    return {"entities": es, "loans": ls, "guarantees": gs, "collateral": items, "limits": limits}
