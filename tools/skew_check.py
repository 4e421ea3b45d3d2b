"""Hot-key check: a third of all returns on one ASIN/SKU.

Runs the report operators on such data with Spark's event log written to
the scratch folder, then reads the log: for every stage, the most shuffle
records any one task read. With map-side partial aggregation no task sees
the hot key's raw rows, only one partial row per map task.

usage: python tools/skew_check.py [sf_dir]  -> one JSON line
"""

from __future__ import annotations

import glob
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def hot_returns(returns):
    from pyspark.sql import functions as F

    hot = F.col("return_quantity") % 3 == 0
    return returns.withColumns({
        "asin": F.when(hot, F.lit("BHOTHOTHOT")).otherwise(F.col("asin")),
        "merchant_sku": F.when(hot, F.lit("hot-ring-sku")).otherwise(F.col("merchant_sku")),
    })


def main():
    from pyspark.sql import functions as F

    from rmalytics import export_returns, monthly_pivot, search_products, suggest_skus, top_returned
    from rmalytics.plans.warehouse import tables
    from rmalytics.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import tempfile
    log_dir = tempfile.mkdtemp(prefix="rmalytics-eventlog-")
    spark = local_session(8, **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                "spark.eventLog.compress": "false",
                                # keep hash partitions apart so per-task reads show skew
                                "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    r, s = tables(spark, sf_dir)
    r = hot_returns(r)
    hot_rows = r.filter(F.col("asin") == "BHOTHOTHOT").count()
    total_rows = r.count()
    spark.sparkContext.setJobGroup("ops", "operators on hot-key data")
    top_returned(r, s, 1996).collect()
    res = search_products(r, s, "ring", (1996, 1997))
    res.products.collect()
    res.products_with_reasons().collect()
    res.combined_reasons.collect()
    export_returns(r, "1995-01-01", "2001-12-31").collect()
    monthly_pivot(r).collect()
    suggest_skus(r, "ring").collect()
    spark.stop()

    ops_stages, per_stage = set(), {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    if (ev.get("Properties") or {}).get("spark.jobGroup.id") == "ops":
                        ops_stages.update(ev.get("Stage IDs", []))
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    st = per_stage.setdefault(ev["Stage ID"], [0, 0, 0])
                    st[0] += 1
                    st[1] += read
                    st[2] = max(st[2], read)
    ops = {k: v for k, v in per_stage.items() if k in ops_stages}
    worst = max(ops.items(), key=lambda kv: kv[1][2]) if ops else (None, [0, 0, 0])
    print(json.dumps({"total_rows": total_rows, "hot_key_rows": hot_rows,
                      "operator_stages": len(ops), "operator_tasks": sum(v[0] for v in ops.values()),
                      "max_shuffle_records_read_by_one_task": worst[1][2],
                      "that_stage_total_records": worst[1][1]}))


if __name__ == "__main__":
    main()
