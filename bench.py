"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of $BENCH_RUNS runs
(one run when the warm-up took over 15 s).

Prints one JSON line. Shared intermediate results are dropped before every run, so each query pays for
everything it needs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepool.plans.catalog import QUERIES  # noqa: E402
from tidepool.plans.queries_intel import forget  # noqa: E402
from tidepool.runtime import build_session  # noqa: E402

HEADLINE = [
    "launch_page", "launch_page_filtered", "creator_page", "day_stats", "daily_analytics", "trader_activity", "first_trades", "sum_u256",
    "build_launches", "market_data", "funding_inflows", "upsert_launches", "funding_components", "pool_intel", "coordinated_rings", "research_walk",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    forget()
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(cpus, "bench")
    times = {}
    for name in names:
        slow = run_once(spark, name, sf_dir) > 15
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(1 if slow else runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
