"""Model parameters. Every operator takes them as overridable arguments."""

from __future__ import annotations

from decimal import Decimal

D = Decimal

# Rating scale best to worst, one-year PD, risk weight, limit factor.
RATING_ORDER = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC")
PD = {
    "AAA": D("0.0001"),
    "AA": D("0.0002"),
    "A": D("0.0005"),
    "BBB": D("0.0025"),
    "BB": D("0.0100"),
    "B": D("0.0500"),
    "CCC": D("0.2000"),
}
UNRATED_PD = D("0.0100")
RISK_WEIGHT = {
    "AAA": D("0.20"),
    "AA": D("0.20"),
    "A": D("0.50"),
    "BBB": D("1.00"),
    "BB": D("1.00"),
    "B": D("1.50"),
    "CCC": D("1.50"),
}
UNRATED_RISK_WEIGHT = D("1.00")
LIMIT_FACTOR = {
    "AAA": D("1.20"),
    "AA": D("1.10"),
    "A": D("1.00"),
    "BBB": D("1.00"),
    "BB": D("0.80"),
    "B": D("0.60"),
    "CCC": D("0.40"),
}
DEFAULT_LIMIT_FACTOR = D("1.00")

LGD = D("0.45")
CAPITAL_RATIO = D("0.08")

# Bands and concentration thresholds.
AMBER_FROM = D("0.75")
RED_FROM = D("1.00")
HHI_HIGH = 0.18
CR_NORMAL_FROM = 0.30
CR_ELEVATED_FROM = 0.50
CR_HIGH_ABOVE = 0.60
SECTOR_HIGH = 0.30
TOP_K = 10
CAPITAL_BASIS_LIMIT = 0.25
REVENUE_BASIS_LIMIT = 0.10
SUB_INVESTMENT_GRADE = ("BB", "B", "CCC")

# Pre-deal policy.
TENOR_CAP = 7
SETTLEMENT_FRACTION = D("0.25")

# Provisioning and valuation adjustments.
STAGE_3_GRADES = ("CCC",)
STAGE_2_GRADES = ("BB", "B")
DISCOUNT_RATE = 0.03
EXPOSURE_VOL = 0.15
CERTAIN_DEFAULT_HAZARD = 5.0
FUNDING_SPREAD = 0.01
COST_OF_CAPITAL = 0.10
OWN_RATING = "AAA"

# Multi-round cascade.
BUFFER_FRACTION = 0.3
FIRESALE_SENSITIVITY = 0.5
FIRESALE_CAP = 0.5

# Macro model (notches per sector at full factor stress; scenario intensities).
SECTOR_SENSITIVITY = {
    "commercial real estate": {"property": 3, "gdp": 1, "rates": 1},
    "energy": {"gdp": 2, "credit_spread": 1},
    "financial services": {"rates": 2, "credit_spread": 2, "gdp": 1},
    "technology": {"gdp": 1, "rates": 1},
    "industrials": {"gdp": 1.5, "credit_spread": 0.5},
    "transport & logistics": {"gdp": 1.5},
    "consumer": {"gdp": 1},
    "healthcare": {"gdp": 0.5},
    "government": {},
}
MACRO_INTENSITY = {
    "property_crash": {"property": 1.0, "gdp": 0.6, "rates": 0.3},
    "rates_shock": {"rates": 1.0, "credit_spread": 0.7},
    "recession": {"gdp": 1.0, "credit_spread": 0.6, "property": 0.4},
    "stagflation": {"rates": 0.8, "gdp": 0.7, "property": 0.5, "credit_spread": 0.6},
}
MACRO_LABEL = {
    "property_crash": "Property crash",
    "rates_shock": "Rates + spread shock",
    "recession": "Broad recession",
    "stagflation": "Stagflation (severe)",
}
MACRO_MAX_NOTCHES = 4
