"""Report order. Operators stay unsorted; a report asks for its order once.

The sort is a range shuffle, so it is paid only where rows are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report -> (column, descending) pairs; the last column breaks ties.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "watchlist": [("utilisation", True), ("entity_id", False)],
    "limit_breaches": [("utilisation", True), ("entity_id", False)],
    "ubo_aggregation": [("ubo", False), ("is_ubo", True), ("utilisation", True), ("entity_id", False)],
    "breakdown": [("head", False), ("contribution_type", False), ("amount", True), ("via", False)],
    "nbfi_cascade": [("nbfi", False), ("contribution_type", False), ("amount", True), ("via", False)],
    "attributed": [("exposure", True), ("owner", False)],
    "credit_risk": [("el", True), ("entity_id", False)],
    "ecl": [("ecl_recognised", True), ("entity_id", False)],
    "xva": [("cva", True), ("entity_id", False)],
    "xva_breakdown": [("total_xva", True), ("entity_id", False)],
    "el_deltas": [("scenario", False), ("el_delta", True), ("entity_id", False)],
    "sector_impacts": [("scenario", False), ("el_delta", True), ("sector", False)],
    "cascade": [("total_loss", True), ("seed", False)],
    "multiround": [("total_loss", True), ("seed", False)],
    "heads": [("head", False)],
}


def ordered(df: DataFrame, report: str) -> DataFrame:
    """Sort ``df`` the way the named report is shown."""
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in ORDERS[report]])
