"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "fund_screen", "preset_members", "asof_trade_nav", "nav_factors", "metrics_at_dates", "rolling_sharpe",
    "quarter_profile", "portfolio_penetration", "ledger_positions", "similarity_edges", "theme_clusters",
    "composite_scores", "interval_performance", "walk_forward", "quality_scores", "trade_rounds",
    "reconcile_totals", "parse_nav_scripts", "upsert_nav",
]


def main() -> None:
    from navloom.plans import catalog
    from navloom.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("navloom-bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    # one untimed run, so that class loading is not charged to the first query
    queries[HEADLINE[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
