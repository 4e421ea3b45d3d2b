"""Benchmark: every plan of the report tables at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. ``load_tables`` is the one-time load of the driver's
tables into the partitioned report tables, ``render_reports`` the one-time
rendering of report files (the ingest plans' input); each query is then
timed to a full collect of its result, best of $BENCH_RUNS runs.
``value`` is the sum over all entries, load included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from rmalytics.plans.registry import QUERIES
    from rmalytics.plans.render import render_all
    from rmalytics.plans.warehouse import load
    from rmalytics.session import local_session

    spark = local_session(cpus, app="rmalytics-bench")
    spark.sparkContext.setLogLevel("ERROR")

    # JVM and code-generation warm-up on the smallest data set (not timed).
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm) and warm != sf_dir:
        QUERIES["top_returned_skus"](spark, warm).collect()

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    load(spark, sf_dir)
    times["load_tables"] = round(time.perf_counter() - t0, 3)
    # report files for the ingest plans, rendered from the driver's tables
    t0 = time.perf_counter()
    render_all(spark, sf_dir)
    times["render_reports"] = round(time.perf_counter() - t0, 3)

    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).collect()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_sec_load_plus_all_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs_per_query": runs,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
