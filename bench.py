"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from linkbook.catalog.queries import book_of, queries  # noqa: E402
from linkbook.session import session  # noqa: E402

HEADLINES = [
    "watchlist",
    "connected_exposure",
    "headline",
    "attributed_exposure",
    "hhi",
    "cr10",
    "sector_shares",
    "ubo_aggregation",
    "pre_deal_check",
    "credit_risk",
    "portfolio_summary",
    "counterparty_ecl",
    "xva_breakdown",
    "scenario_snapshots",
    "macro_compare",
    "severity_grid",
    "default_cascade",
    "default_cascade_multiround",
    "structural_wrong_way_risk",
    "general_wrong_way_risk",
    "import_report",
    "triples_by_predicate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    times: dict[str, float] = {}

    started = time.perf_counter()
    book = book_of(spark, folder)
    times["book_tables"] = time.perf_counter() - started
    started = time.perf_counter()
    book.ownership.write.format("noop").mode("overwrite").save()
    times["ownership_walk"] = time.perf_counter() - started
    for name in only:
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - started
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
