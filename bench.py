"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

HEADLINE = [
    "band_horizon", "outcome_path", "damaged_outcomes", "feature_contribution", "spearman", "trade_window", "consecutive_windows", "alpha_score", "asof_nearest", "quote_usd", "liquidity_growth", "liquidity_stability",
    "holder_balances", "transfer_net", "clusters", "top10_concentration", "risk_decision", "signal_states", "insert_if_absent", "pool_token_join",
]


def main() -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import session

    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
