"""The dashboard: book-level metrics for all, rows scoped to what the reader may see."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkbook.book import Book
from linkbook.operators import concentration as C
from linkbook.operators.access import scope_rows
from linkbook.operators.exposure import attributed_view
from linkbook.operators.limits import watchlist
from linkbook.operators.wrong_way import structural_wwr
from linkbook.plans.staging import stage


PARTS = ("hhi", "cr10", "sectors", "countries", "ratings", "watchlist", "wwr", "exposures")


def dashboard(book: Book, visible: DataFrame | None = None, parts: Sequence[str] = PARTS) -> dict[str, DataFrame]:
    """Named DataFrames over one book; only the ``parts`` asked for cost anything."""
    if visible is not None and {"watchlist", "wwr", "exposures"} & set(parts):
        visible = stage(visible.select("head").distinct(), "visible")

    def flags() -> DataFrame:
        rows = structural_wwr(book)
        if visible is None:
            return rows
        return scope_rows(rows.withColumn("entity_id", F.col("borrower")), book, visible, ("entity_id",)).drop("entity_id")

    made: dict[str, Callable[[], DataFrame]] = {
        "hhi": lambda: C.hhi_direct_connected(book),
        "cr10": lambda: C.cr_direct_connected(book),
        "sectors": lambda: C.sector_shares(book),
        "countries": lambda: C.country_shares(book),
        "ratings": lambda: C.rating_shares(book),
        "watchlist": lambda: scope_rows(watchlist(book), book, visible, ("entity_id",)),
        "wwr": flags,
        "exposures": lambda: scope_rows(attributed_view(book), book, visible, ("owner",)),
    }
    return {name: made[name]() for name in parts}
