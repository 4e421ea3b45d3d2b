"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that hold
them). A flow routes the patterns' words to the sources' quotas: a pattern
offers its words once at cost 0 and each further time at a cost one higher, so
that nothing is repeated while fresh words are left, and the cheapest flow
spreads quotas over shared documents. A pattern that gets f of its s words takes
every document f // s times and a seeded selection of f % s words once more.

The selection needs no global sort: documents are dealt to cells of about
``cell_docs`` by a seeded hash, whole cells are taken in order while they fit,
and in the one cell of each pattern that is left the documents are taken in
seeded order wherever they fit, and one more if that comes nearer. Patterns and sources are a corpus's named
parts: their sums, and nothing of single documents, are handled on the driver.

Edge cases: a null source is a source of its own, after all others; null and
empty texts have size 0 and are never taken; rows with equal id and text
are taken or left together, however many they are; a source without words has target 0; an empty table
gives no rows. Columns made here replace columns of the same names.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rmalytics.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
CELL_DOCS = 1024
MADE = ["size", "credited_source", "source_size", "target", "copies", "taken"]


def code_point_order(sources: Iterable[str | None]) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def quotas(sizes: dict[str | None, int], weights: tuple[int, ...], budget: Fraction, most: int) -> dict[str | None, Fraction]:
    """Each source's share of ``budget`` by its weight, at most ``most`` times its size."""
    names = code_point_order(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = budget, {}, list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(supply: dict[str, int], members: dict[str, list], demand: dict[str | None, int], most: int) -> dict[tuple[str, str | None], int]:
    """Words routed from each pattern to each source, by successive cheapest paths.

    A path visits patterns and sources in turn: it takes words from a pattern
    at its next repetition's cost, and may reroute words that an earlier path
    sent, until it ends at a source with demand left.
    """
    flow = {(p, s): 0 for p in supply for s in members[p]}
    used = dict.fromkeys(supply, 0)
    need = dict(demand)
    holders: dict[str | None, list[str]] = {}
    for p, ms in members.items():
        for s in ms:
            holders.setdefault(s, []).append(p)
    # rerouting costs nothing, so the cheapest path starts at the reachable pattern of fewest repetitions
    for level in range(most):
        room = {p: supply[p] * (level + 1) - used[p] for p in supply}
        while True:
            came: dict = {}
            todo = deque()
            for p in sorted(supply):
                if room[p] > 0:
                    came["p", p] = None
                    todo.append(("p", p))
            end = None
            while todo and end is None:
                kind, x = at = todo.popleft()
                if kind == "p":
                    after = [("s", s) for s in members[x]]
                else:
                    if need.get(x, 0) > 0:
                        end = at
                        break
                    after = [("p", q) for q in holders[x] if flow[q, x] > 0]
                for y in after:
                    if y not in came:
                        came[y] = at
                        todo.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(room[path[0][1]], need[end[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "s":
                    amount = min(amount, flow[b[1], a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1], b[1]] += amount
                else:
                    flow[b[1], a[1]] -= amount
            room[path[0][1]] -= amount
            used[path[0][1]] += amount
            need[end[1]] -= amount
    return flow


def _choose(cell: pd.DataFrame) -> pd.DataFrame:
    """Of a cell's documents, in seeded order, those that still fit."""
    units = cell.groupby("h", sort=True)["words"].sum()
    left, chosen = int(cell["room"].iloc[0]), []
    for h, size in units.items():
        if 0 < size <= left:
            chosen.append(int(h))
            left -= int(size)
    # one more may come nearer from above
    rest = units[(units > 0) & (units < 2 * left) & ~units.index.isin(chosen)]
    if len(rest):
        chosen.append(int((rest - left).abs().idxmin()))
    return pd.DataFrame({"p": [cell["p"].iloc[0]], "cell": [cell["cell"].iloc[0]], "chosen": [chosen]})


def mix_sources(
    spark: SparkSession,
    df: DataFrame,
    members: Column,
    id_col: str = "doc_id",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    ratio: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 17,
    cell_docs: int = CELL_DOCS,
) -> DataFrame:
    """All rows of ``df`` with size, credited_source, source_size, target, copies and taken.

    ``members`` is the array of the sources that hold a document; of several,
    the one credited is drawn by the seed in proportion to the flow.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # of the text too: rows without an id, or with the same one, aren't one unit
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), "_size", F.col(text).cast("string"))
    keyed = df.withColumn("_size", size).withColumns({"_p": F.to_json(F.sort_array(F.array_distinct(members))), "_h": h})
    folder = scratch_path(spark, "mix")
    keyed.select(F.col("_p").alias("p"), F.col("_size").alias("size"), F.col("_h").alias("h")).write.parquet(f"{folder}/docs")
    slim = spark.read.parquet(f"{folder}/docs")

    sums = {r.p: (r.s, r.n) for r in slim.groupBy("p").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    holds = {p: json.loads(p) for p in sums}
    sizes: dict[str | None, int] = {}
    for p, (s, _) in sums.items():
        for m in holds[p]:
            sizes[m] = sizes.get(m, 0) + s
    want = quotas(sizes, weights, ratio * sum(s for s, _ in sums.values()), most)
    flow = min_cost_flow({p: s for p, (s, _) in sums.items()}, holds, {s: round(t) for s, t in want.items()}, most)

    plan = []
    for p, (s, n) in sums.items():
        routed = [(m, flow[p, m]) for m in code_point_order(holds[p])]
        f = sum(x for _, x in routed)
        full, rest = divmod(f, s) if s else (0, 0)
        # the sources' bounds on [0, 1) in proportion to the flow
        bounds, at = [], 0
        for m, x in routed:
            at += x
            bounds.append((m, at / f if f else 1.0, sizes[m], float(want[m])))
        plan.append((p, full, rest, -(-n // cell_docs), bounds))
    kind = "p string, full long, rest long, cells long, bounds array<struct<source: string, upto: double, source_size: long, target: double>>"
    plan = spark.createDataFrame(plan, kind)  # a row for each membership pattern

    unit = F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53))
    to_cell = F.least(F.floor(unit * F.col("cells")), F.col("cells") - 1).cast("long")
    slim = slim.join(plan.select("p", "rest", "cells"), "p").withColumn("cell", to_cell)
    cells = slim.groupBy("p", "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    before = F.sum("words").over(W.partitionBy("p").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("room", F.col("rest") - F.coalesce(before, F.lit(0)))
    cells.select("p", "cell", "room", (F.col("room") >= F.col("words")).alias("whole")).write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    edge = cells.where((F.col("room") > 0) & ~F.col("whole")).select("p", "cell", "room")
    # equal rows are summed before a cell's units come together in one task
    units = slim.select("p", "cell", "h", "size").join(edge, ["p", "cell"]).groupBy("p", "cell", "room", "h").agg(F.sum("size").alias("words"))
    chosen = units.groupBy("p", "cell").applyInPandas(_choose, "p string, cell long, chosen array<long>")
    chosen.write.parquet(f"{folder}/chosen")
    cells = cells.join(spark.read.parquet(f"{folder}/chosen"), ["p", "cell"], "left").select("p", "cell", "whole", "chosen")

    out = keyed.drop(*[c for c in MADE if c in df.columns])
    out = out.join(plan.select(F.col("p").alias("_p"), "full", "cells", "bounds"), "_p")
    unit = F.shiftrightunsigned(F.col("_h"), 11) / F.lit(float(1 << 53))
    out = out.withColumn("_cell", F.least(F.floor(unit * F.col("cells")), F.col("cells") - 1).cast("long"))
    cells = cells.select(F.col("p").alias("_p"), F.col("cell").alias("_cell"), F.col("whole").alias("_whole"), F.col("chosen").alias("_chosen"))
    out = out.join(cells, ["_p", "_cell"])
    again = F.when(F.col("_whole") | F.coalesce(F.array_contains("_chosen", F.col("_h")), F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, F.col("full") + again).otherwise(F.lit(0)).cast("int")
    bound = F.coalesce(F.get(F.filter("bounds", lambda b: unit < b["upto"]), F.lit(0)), F.element_at("bounds", -1))
    out = out.withColumns({"_bound": bound, "copies": copies})
    out = out.withColumns(
        {
            "size": F.col("_size"),
            "credited_source": F.col("_bound.source"),
            "source_size": F.col("_bound.source_size"),
            "target": F.col("_bound.target"),
            "taken": F.col("_size") * F.col("copies"),
        }
    )
    return out.drop("_p", "_h", "_cell", "_size", "_whole", "_chosen", "_bound", "full", "cells", "bounds")
