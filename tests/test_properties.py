"""Property tests: operators against brute-force Python on random small tables."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rmalytics import (
    export_returns,
    monthly_pivot,
    returns_by_year_month,
    search_products,
    suggest_skus,
    top_returned,
)
from rmalytics.functions.dates import month_number
from rmalytics.operators.monthly import SLOTS
from rmalytics.schemas import MONTHS

E_ACUTE, E_ACUTE_UP = chr(0xE9), chr(0xC9)
ASINS = ["A1", "a1", "A2", "b3", None]
SKUS = ["S1", "s1", "s2", "T_1", "x%y", "se2", "s" + E_ACUTE + "2", "S" + E_ACUTE_UP + "2",
        "STRASSE", "stra" + chr(0xDF) + "e", "L" + chr(0x142) + "d", "", None]
REASONS = ["Too small", "too small", "Defective", "D" + E_ACUTE + "fective", ""]
YEARS = [2023, 2024, 2025]

ret_row = st.tuples(st.sampled_from(ASINS), st.sampled_from(SKUS), st.integers(1, 9),
                    st.sampled_from(REASONS), st.sampled_from(list(MONTHS) + ["Foo"]),
                    st.sampled_from(YEARS))
sale_row = st.tuples(st.sampled_from(ASINS[:4] + ["A4"]), st.integers(0, 9), st.sampled_from(YEARS))
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, rrows, srows):
    r = spark.createDataFrame(rrows, "asin string, merchant_sku string, return_quantity int, "
                                     "return_reason string, month string, year int")
    r = r.withColumn("month_no", F.when(month_number(F.col("month")) > 0, month_number(F.col("month"))))
    r = r.withColumn("last_updated", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    s = spark.createDataFrame(srows, "asin string, quantity int, year int")
    return r, s


def unaccent_lower(v):
    """Model of the source collation: accents dropped (NFD), letter case
    ignored, and the collation's equalities for undecomposed letters."""
    import unicodedata

    k = "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn").lower()
    # the collation's equalities, stated here apart from the engine's tables
    for a, b in zip("øđħłŧßæœĳ", ("o", "d", "h", "l", "t", "ss", "ae", "oe", "ij"), strict=True):
        k = k.replace(a, b)
    return k


def fk(v, fold):
    """Grouping key of a text value: folded or exact."""
    return unaccent_lower(v) if (fold and v is not None) else v


def shown(values):
    """Displayed spelling of a group: the smallest non-NULL value."""
    vals = [v for v in values if v is not None]
    return min(vals) if vals else None


def nkey(v):
    return (v is not None, v or "")


def rate(a, b, mode):
    if not b:
        return None
    q = (Decimal(a) * 100 / Decimal(b)).quantize(Decimal("0.01"),
                                                 ROUND_HALF_UP if mode == "up" else ROUND_HALF_EVEN)
    return float(q)


@SETTINGS
@given(st.lists(ret_row, min_size=0, max_size=25), st.lists(sale_row, max_size=15))
def test_monthly_matches_brute_force(spark, rrows, srows):
    r, _ = frames(spark, rrows, srows)
    want = defaultdict(lambda: [0] * 12)
    for a, k, q, why, m, y in rrows:
        want[y]
        if m in MONTHS:
            want[y][MONTHS.index(m)] += q
    got = {x.year: [x[s] for s in SLOTS] for x in monthly_pivot(r).collect()}
    assert got == dict(want)
    series = defaultdict(int)
    for a, k, q, why, m, y in rrows:
        series[(y, m)] += q
    assert {(x.year, x.month): x.total_return_quantity
            for x in returns_by_year_month(r).collect()} == dict(series)


@SETTINGS
@given(st.lists(ret_row, min_size=1, max_size=25), st.lists(sale_row, max_size=15),
       st.sampled_from(YEARS), st.integers(1, 4), st.booleans())
def test_top_returned_matches_brute_force(spark, rrows, srows, year, n, fold):
    r, s = frames(spark, rrows, srows)
    per = defaultdict(int)
    spell = defaultdict(lambda: ([], []))
    for a, k, q, why, m, y in rrows:
        if y == year:
            key = (fk(a, fold), fk(k, fold))
            per[key] += q
            spell[key][0].append(a)
            spell[key][1].append(k)
    sold = defaultdict(int)
    for a, q, y in srows:
        if y == year and a is not None:
            sold[fk(a, fold)] += q
    top = sorted(per.items(), key=lambda kv: (-kv[1], nkey(kv[0][0]), nkey(kv[0][1])))[:n]
    want = []
    for key, t in top:
        ts = sold.get(key[0]) if key[0] is not None else None
        want.append((shown(spell[key][0]), shown(spell[key][1]), t, ts, rate(t, ts, "even")))
    assert [tuple(x) for x in top_returned(r, s, year, n, fold_case=fold).collect()] == want


def like(term, text):
    """LIKE '%term%' without regard to letter case and accents."""
    import re
    if text is None:
        return False
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in unaccent_lower(term))
    return re.fullmatch(f".*{rx}.*", unaccent_lower(text), re.S) is not None


@SETTINGS
@given(st.lists(ret_row, min_size=0, max_size=25), st.lists(sale_row, max_size=15),
       st.sampled_from(["a", "S", "_1", "%", "x", "zz", "2", "s1", "e2", "S" + E_ACUTE_UP, "ss", "ld"]),
       st.booleans())
def test_search_matches_brute_force(spark, rrows, srows, term, fold):
    r, s = frames(spark, rrows, srows)
    years = (2023, 2024)
    res = search_products(r, s, term, years, fold_case=fold)
    m = [row for row in rrows if like(term, row[1]) or like(term, row[0])]
    prods = {}
    for a, k, q, why, mo, y in m:
        p = prods.setdefault(fk(a, fold), {"asins": [], "skus": defaultdict(list), 2023: 0, 2024: 0})
        p["asins"].append(a)
        p["skus"][fk(k, fold)].append(k)
        if y in years:
            p[y] += 1
    sales = defaultdict(int)
    for a, q, y in srows:
        if y in years and a is not None:
            sales[(fk(a, fold), y)] += q
    got = {x.asin: x for x in res.products.collect()}
    assert set(got) == {shown(p["asins"]) for p in prods.values()}
    for ak, p in prods.items():
        x = got[shown(p["asins"])]
        skus = sorted(v for v in (shown(vs) for vs in p["skus"].values()) if v is not None)
        assert x.merchant_skus == (",".join(skus) if skus else None)
        for y in years:
            sy = sales[(ak, y)] if ak is not None else 0
            assert (x[f"returns_{y}"], x[f"sales_{y}"]) == (p[y], sy)
            assert x[f"return_rate_{y}"] == rate(p[y], sy, "up")
    summ = res.summary.collect()[0]
    for y in years:
        tr = sum(p[y] for p in prods.values())
        ts = sum(sales[(a, y)] for a in prods if a is not None)
        assert (summ[f"total_returns_{y}"], summ[f"total_sales_{y}"]) == (tr, ts)
        assert summ[f"return_rate_{y}"] == (rate(tr, ts, "even") if ts else 0.0)
    comb = {x.return_reason: (x.count_2023, x.count_2024) for x in res.combined_reasons.collect()}
    want = {}
    for a, k, q, why, mo, y in m:
        w = want.setdefault(fk(why, fold), {"names": [], 2023: 0, 2024: 0})
        w["names"].append(why)
        if y in years:
            w[y] += 1
    assert comb == {shown(w["names"]): (w[2023], w[2024]) for w in want.values()}
    # nested reasons add up to the product's counts, most frequent first
    for x in res.products_with_reasons().collect():
        assert sum(e["count_2024"] for e in x.return_reasons) == x.returns_2024
        c = [e["count_2024"] for e in x.return_reasons]
        assert c == sorted(c, reverse=True)


@SETTINGS
@given(st.lists(ret_row, min_size=0, max_size=25), st.dates(dt.date(2022, 11, 1), dt.date(2026, 2, 1)),
       st.integers(0, 800), st.booleans())
def test_export_matches_brute_force(spark, rrows, start, span, fold):
    r, _ = frames(spark, rrows, [])
    end = start + dt.timedelta(days=span)
    groups = {}
    for a, k, q, why, m, y in rrows:
        if m in MONTHS and start <= dt.date(y, MONTHS.index(m) + 1, 1) <= end:
            g = groups.setdefault((fk(a, fold), fk(k, fold)), [[], [], 0])
            g[0].append(a)
            g[1].append(k)
            g[2] += q
    want = {(shown(g[0]), shown(g[1])): g[2] for g in groups.values()}
    got = {(x.asin, x.merchant_sku): x.return_quantity
           for x in export_returns(r, start, end, fold_case=fold).collect()}
    assert got == want


@SETTINGS
@given(st.lists(ret_row, min_size=0, max_size=25), st.sampled_from(["s", "1", "_", "%", "T", "q", E_ACUTE]),
       st.integers(1, 3), st.booleans())
def test_suggest_matches_brute_force(spark, rrows, term, n, fold):
    r, _ = frames(spark, rrows, [])
    groups = defaultdict(list)
    for _, k, *_ in rrows:
        if like(term, k):
            groups[fk(k, fold)].append(k)
    want = sorted(shown(v) for v in groups.values())[:n]
    assert [x.merchant_sku for x in suggest_skus(r, term, n, fold_case=fold).collect()] == want
