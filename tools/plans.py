"""Write PLANS.md: the physical plan tree of every registered plan, with
each scan's partition filters, pushed filters and read schema.

usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(tree: str, details: str) -> str:
    """One line: shuffles, broadcasts, aggregates, pruned/pushed scans."""
    hashx = len(re.findall(r"hashpartitioning", details))
    rangex = len(re.findall(r"rangepartitioning", details))
    bcast = tree.count("BroadcastExchange")
    joins = sorted(set(re.findall(r"(BroadcastHashJoin \w+|SortMergeJoin \w*)", tree)))
    aggs = {k: len(re.findall(rf"(?<![A-Za-z]){k} \(", tree))
            for k in ("HashAggregate", "ObjectHashAggregate", "SortAggregate")}
    scans = details.count("Scan parquet")
    pruned = len(re.findall(r"PartitionFilters: \[[^\]]", details))
    pushed = len(re.findall(r"PushedFilters: \[[^\]]", details))
    agg = ", ".join(f"{k} x{v}" for k, v in aggs.items() if v)
    return (f"shuffles: {hashx} hash + {rangex} range; broadcasts: {bcast}"
            f"{' (' + ', '.join(j.strip() for j in joins) + ')' if joins else ''}; "
            f"aggregates: {agg or 'none'}; parquet scans: {scans}, "
            f"with partition filters: {pruned}, with pushed filters: {pushed}")


def digest(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    head = summary(tree, details)
    tree = tree.replace("== Physical Plan ==\n", "")
    scans = []
    for block in details.split("\n\n"):
        if "Scan parquet" not in block.splitlines()[0] if block.strip() else True:
            continue
        keep = [ln for ln in block.splitlines()
                if ln.startswith(("(", "PartitionFilters", "PushedFilters", "ReadSchema"))]
        keep = [re.sub(r"#\d+L?", "", ln) for ln in keep]
        scans.append("\n".join(keep))
    return head + "\n\n" + tree.rstrip() + "\n\n" + "\n\n".join(scans)


def main():
    from rmalytics.plans.registry import QUERIES
    from rmalytics.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered plans\n")
    print(f"Generated by `python tools/plans.py {sf_dir}` (AQE on: the final plan may switch")
    print("join strategies at run time and reuses identical exchanges). The ingest roundtrips")
    print("write files first; their plan shown is the final summary over the loaded table.\n")
    for name, fn in QUERIES.items():
        print(f"## {name}\n\n```\n{digest(fn(spark, sf_dir))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
