"""Single-node proxy timings: every oracle SQL in DuckDB on the same files.

usage: python tools/duck_bench.py [sf_dir]  -> one JSON line (best of 2 runs).
The oracle recomputes the derived returns/sales from the raw tables each
time, i.e. it measures load + query together.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    import duckdb

    from rmalytics.plans.registry import ORACLE
    from tools.compare import TABLES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    times = {}
    for name, sql in ORACLE.items():
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "value": round(sum(times.values()), 3),
                      "queries": times}))


if __name__ == "__main__":
    main()
