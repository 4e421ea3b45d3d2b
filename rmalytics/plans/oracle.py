"""DuckDB SQL for every registered plan, over the driver's tables.

Text keys use FOLD(x), expanded to the same steps as the Spark fold.
Rates use integer arithmetic so that the oracle's rounding is exact:
half-up  = (a*20000 + b) // (2*b) / 100
half-even: q = a*10000 // b, r = a*10000 % b; q + 1 if 2r > b or (2r = b and q odd)
"""

from __future__ import annotations

# Letters that the source's collation (utf8mb4_0900_ai_ci) holds equal to others
# and that Unicode does not decompose; stated apart from the engine's tables.
EQUAL_LETTERS = ("øđħłŧ", "odhlt")
EQUAL_TEXTS = {"ß": "ss", "æ": "ae", "œ": "oe", "ĳ": "ij"}

VIEWS = """
returns AS (
  SELECT 'B' || lpad(CAST(l.l_partkey // 4 AS VARCHAR), 9, '0') AS asin,
         replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS VARCHAR) AS merchant_sku,
         CAST(l.l_quantity AS INTEGER) AS return_quantity,
         o.o_orderpriority AS return_reason,
         strftime(l.l_shipdate, '%B') AS month,
         CAST(month(l.l_shipdate) AS INTEGER) AS month_no,
         CAST(year(l.l_shipdate) AS INTEGER) AS year,
         CAST(l.l_shipdate AS TIMESTAMP) AS last_updated
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_returnflag = 'R'
),
sales AS (
  SELECT 'B' || lpad(CAST(l.l_partkey // 4 AS VARCHAR), 9, '0') AS asin,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         strftime(o.o_orderdate, '%B') AS month,
         CAST(month(o.o_orderdate) AS INTEGER) AS month_no,
         CAST(year(o.o_orderdate) AS INTEGER) AS year
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

MONTHS_SQL = ("January", "February", "March", "April", "May", "June", "July",
              "August", "September", "October", "November", "December")


def fold_sql(x: str) -> str:
    """SQL for the comparison key of text ``x`` (rmalytics.functions.keys.fold):
    accents stripped, lower case, the collation's letter equalities."""
    k = f"lower(strip_accents({x}))"
    k = f"translate({k}, '{EQUAL_LETTERS[0]}', '{EQUAL_LETTERS[1]}')"
    for a, b in EQUAL_TEXTS.items():
        k = f"replace({k}, '{a}', '{b}')"
    return k


def expand_fold(sql: str) -> str:
    """Replace every FOLD(<expr>) by fold_sql(<expr>) (parentheses matched,
    quoted text skipped)."""
    out, i = [], 0
    while True:
        j = sql.find("FOLD(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, quote = j + 5, 1, False
        while depth:
            ch = sql[k]
            if ch == "'":
                quote = not quote
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")":
                depth -= 1
            k += 1
        out.append(fold_sql(expand_fold(sql[j + 5:k - 1])))
        i = k


def with_views(body: str, extra_ctes: str = "") -> str:
    ctes = VIEWS + ("," + extra_ctes if extra_ctes else "")
    return expand_fold(f"WITH {ctes}\n{body}")


def half_up(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST((({a}) * 20000 + ({b})) // (2 * ({b})) AS DOUBLE) / 100.0 END)"


def half_even(a: str, b: str) -> str:
    q = f"((({a}) * 10000) // ({b}))"
    r = f"((({a}) * 10000) % ({b}))"
    return (f"(CASE WHEN {b} > 0 THEN CAST({q} + CASE WHEN 2 * {r} > ({b}) OR "
            f"(2 * {r} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100.0 END)")


def like(term: str) -> str:
    return "'%" + term.replace("'", "''") + "%'"


def top_returned(year: int, n: int) -> str:
    return with_views(f"""
SELECT asin, merchant_sku, total_returns, total_sold, return_pct FROM top
ORDER BY total_returns DESC, ak, sk""", _top_cte(year, n))


def returns_by_year_month() -> str:
    return with_views("""
SELECT year, month, CAST(SUM(return_quantity) AS BIGINT) AS total_return_quantity
FROM returns GROUP BY year, month ORDER BY year, month""")


def _slots(src: str = "returns") -> str:
    cols = ",\n       ".join(
        f"CAST(COALESCE(SUM(CASE WHEN month = '{m}' THEN return_quantity END), 0) AS BIGINT) AS {m.lower()}"
        for m in MONTHS_SQL)
    return f"SELECT year,\n       {cols}\nFROM {src} GROUP BY year"


def monthly_pivot() -> str:
    total = " + ".join(m.lower() for m in MONTHS_SQL)
    return with_views(f"SELECT *, {total} AS total FROM ({_slots()}) p ORDER BY year")


def yearly_total() -> str:
    total = " + ".join(m.lower() for m in MONTHS_SQL)
    return with_views(f"SELECT year, {total} AS total FROM ({_slots()}) p ORDER BY year")


def year_series(years) -> str:
    ys = ", ".join(f"({int(y)})" for y in years)
    slots = ", ".join(f"CAST(COALESCE(p.{m.lower()}, 0) AS BIGINT) AS {m.lower()}" for m in MONTHS_SQL)
    total = " + ".join(f"COALESCE(p.{m.lower()}, 0)" for m in MONTHS_SQL)
    return with_views(f"""
SELECT w.year, {slots}, CAST({total} AS BIGINT) AS total
FROM (VALUES {ys}) w(year) LEFT JOIN ({_slots()}) p ON w.year = p.year
ORDER BY w.year""")


def _matched(term: str, literal: bool = False) -> str:
    # LIKE without regard to letter case or accents, as the source collation
    if not term.strip():
        return "matched AS (SELECT * FROM returns WHERE false)"
    t = term.strip().replace("'", "''")
    if literal:
        cond = " OR ".join(f"contains(FOLD({c}), FOLD('{t}'))"
                           for c in ("merchant_sku", "asin"))
    else:
        cond = " OR ".join(f"FOLD({c}) LIKE FOLD('%{t}%')"
                           for c in ("merchant_sku", "asin"))
    return f"matched AS (SELECT * FROM returns WHERE {cond})"


def _products_ctes(term: str, years, literal: bool = False) -> str:
    rc = ", ".join(f"SUM(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS r{y}" for y in years)
    ra = ", ".join(f"CAST(SUM(r{y}) AS BIGINT) AS returns_{y}" for y in years)
    sc = ", ".join(f"SUM(CASE WHEN year = {y} THEN quantity ELSE 0 END) AS s{y}" for y in years)
    pc = ", ".join(
        f"pa.returns_{y}, CAST(COALESCE(s.s{y}, 0) AS BIGINT) AS sales_{y}, "
        f"{half_up(f'pa.returns_{y}', f'COALESCE(s.s{y}, 0)')} AS return_rate_{y}" for y in years)
    return f"""{_matched(term, literal)},
per_sku AS (SELECT FOLD(asin) AS ak, FOLD(merchant_sku) AS sk, min(asin) AS asin,
                   min(merchant_sku) AS merchant_sku, {rc}
            FROM matched GROUP BY 1, 2),
per_asin AS (SELECT ak, min(asin) AS asin,
                    string_agg(merchant_sku, ',' ORDER BY merchant_sku) AS merchant_skus, {ra}
             FROM per_sku GROUP BY ak),
s AS (SELECT FOLD(asin) AS ak, {sc} FROM sales GROUP BY 1),
products AS (SELECT pa.asin, pa.merchant_skus, {pc} FROM per_asin pa LEFT JOIN s ON pa.ak = s.ak)"""


def product_search(term: str, years, literal: bool = False) -> str:
    return with_views(f"SELECT * FROM products ORDER BY returns_{years[-1]} DESC, asin",
                      _products_ctes(term, years, literal))


def _reason_ctes(years) -> str:
    cc = ", ".join(f"CAST(SUM(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS BIGINT) AS count_{y}"
                   for y in years)
    return (f"reasons AS (SELECT FOLD(asin) AS ak, FOLD(return_reason) AS rk, min(asin) AS asin, "
            f"min(return_reason) AS return_reason, {cc} FROM matched GROUP BY 1, 2)")


def return_reasons(term: str, years) -> str:
    cols = ", ".join(f"count_{y}" for y in years)
    return with_views(f"SELECT asin, return_reason, {cols} FROM reasons "
                      f"ORDER BY ak, count_{years[-1]} DESC, rk",
                      f"{_matched(term)},\n{_reason_ctes(years)}")


def nested_reasons_json(term: str, years) -> str:
    fields = ", ".join(["reason := return_reason"] + [f"count_{y} := count_{y}" for y in years])
    body = f"""
SELECT p.*, COALESCE(CAST(to_json(n.rr) AS VARCHAR), '[]') AS return_reasons_json
FROM products p LEFT JOIN (
  SELECT ak, list(struct_pack({fields}) ORDER BY count_{years[-1]} DESC, return_reason) AS rr
  FROM reasons GROUP BY ak) n
ON FOLD(p.asin) IS NOT DISTINCT FROM n.ak"""
    return with_views(body, f"{_products_ctes(term, years)},\n{_reason_ctes(years)}")


def search_summary(term: str, years) -> str:
    tot = ", ".join(
        f"CAST(COALESCE(SUM(returns_{y}), 0) AS BIGINT) AS total_returns_{y}, "
        f"CAST(COALESCE(SUM(sales_{y}), 0) AS BIGINT) AS total_sales_{y}" for y in years)
    rates = ", ".join(
        f"COALESCE({half_even(f'total_returns_{y}', f'total_sales_{y}')}, 0.0) AS return_rate_{y}"
        for y in years)
    return with_views(f"SELECT *, {rates} FROM (SELECT COUNT(*) AS product_count, {tot} FROM products) t",
                      _products_ctes(term, years))


def combined_reasons(term: str, years) -> str:
    cc = ", ".join(f"CAST(SUM(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS BIGINT) AS count_{y}"
                   for y in years)
    return with_views(
        f"SELECT min(return_reason) AS return_reason, {cc} FROM matched GROUP BY FOLD(return_reason) "
        f"ORDER BY count_{years[-1]} DESC, FOLD(return_reason)", _matched(term))


def rate_bands(term: str, years) -> str:
    extra = ", ".join(
        f"CASE WHEN return_rate_{y} > 10 THEN 'danger' WHEN return_rate_{y} > 5 THEN 'warning' "
        f"ELSE 'none' END AS rate_band_{y}, COALESCE(returns_{y} > 0, false) AS has_returns_{y}"
        for y in years)
    return with_views(f"SELECT *, {extra} FROM products ORDER BY returns_{years[-1]} DESC, asin",
                      _products_ctes(term, years))


def export_range(start: str, end: str) -> str:
    return with_views(f"""
SELECT min(asin) AS asin, min(merchant_sku) AS merchant_sku,
       CAST(SUM(return_quantity) AS BIGINT) AS return_quantity
FROM returns
WHERE CAST(try_strptime('01-' || month || '-' || CAST(year AS VARCHAR), '%d-%B-%Y') AS DATE)
      BETWEEN DATE '{start}' AND DATE '{end}'
GROUP BY FOLD(asin), FOLD(merchant_sku)""")


def suggest_skus(term: str, n: int) -> str:
    return with_views(f"""
SELECT min(merchant_sku) AS merchant_sku FROM returns
WHERE FOLD(merchant_sku) LIKE FOLD({like(term)})
GROUP BY FOLD(merchant_sku) ORDER BY 1 LIMIT {n}""")


def freshness() -> str:
    return with_views("""
SELECT MAX(last_updated) AS last_updated, strftime(MAX(last_updated), '%m-%d-%Y') AS last_updated_text
FROM returns""")


def ingest_returns_roundtrip() -> str:
    name = ("CASE WHEN l_linenumber = 3 THEN 'Item \"' || CAST(l_partkey AS VARCHAR) || '\"' || chr(9) "
            "|| 'deluxe' || chr(10) || chr(233) || 'dition' ELSE 'Item ' || CAST(l_partkey AS VARCHAR) END")
    return f"""
SELECT CAST(CASE WHEN l_linenumber % 2 = 0 THEN year(l_shipdate) % 100 + 2000
                 ELSE year(l_shipdate) END AS INTEGER) AS year,
       strftime(l_shipdate, '%B') AS month,
       CAST(SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS return_units,
       COUNT(*) AS return_lines,
       CAST(SUM(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS BIGINT) AS blank_reasons,
       CAST(SUM(length({name})) AS BIGINT) AS name_chars,
       COUNT(*) AS mapped_lines, COUNT(*) AS stamped_lines
FROM lineitem WHERE l_returnflag = 'R'
GROUP BY 1, 2"""


def ingest_returns_quarantine() -> str:
    return """
SELECT CASE WHEN bad_d OR bad_q THEN 'rejected' ELSE 'loaded' END AS status,
       concat_ws('; ', CASE WHEN bad_d THEN 'bad Return request date' END,
                       CASE WHEN bad_q THEN 'bad Return quantity' END) AS error,
       COUNT(*) AS rows
FROM (SELECT l_orderkey % 7 = 0 AS bad_d, l_orderkey % 11 = 0 AS bad_q
      FROM lineitem WHERE l_returnflag = 'R') t
GROUP BY 1, 2"""


def ingest_sales_roundtrip() -> str:
    return """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
       strftime(l_shipdate, '%B') AS month,
       CAST(SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS units,
       COUNT(*) AS lines,
       CAST(SUM(CASE WHEN l_linenumber IN (1, 2) OR (l_linenumber <> 7 AND l_extendedprice = 0)
                THEN 1 ELSE 0 END) AS BIGINT) AS zero_prices,
       CAST(SUM(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS BIGINT) AS null_prices,
       CAST(SUM(CASE WHEN l_linenumber <> 5 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT)
         AS business_lines,
       COUNT(*) AS mapped_lines, COUNT(*) AS stamped_lines
FROM lineitem
GROUP BY 1, 2"""


def _top_cte(year: int, n: int) -> str:
    # keys compare without letter case; a group shows its smallest spelling
    return f"""top AS (
  SELECT asin, merchant_sku, total_returns, total_sold, ak, sk,
         {half_even('total_returns', 'total_sold')} AS return_pct
  FROM (
    SELECT r.asin, r.merchant_sku, r.total_returns, s.total_sold, r.ak, r.sk
    FROM (SELECT FOLD(asin) AS ak, FOLD(merchant_sku) AS sk, min(asin) AS asin,
                 min(merchant_sku) AS merchant_sku,
                 CAST(SUM(return_quantity) AS BIGINT) AS total_returns
          FROM returns WHERE year = {year} GROUP BY 1, 2) r
    LEFT JOIN (SELECT FOLD(asin) AS ak, CAST(SUM(quantity) AS BIGINT) AS total_sold
               FROM sales WHERE year = {year} GROUP BY 1) s
    ON r.ak = s.ak
    ORDER BY r.total_returns DESC, r.ak, r.sk
    LIMIT {n}) t)"""


def display_format(year: int, n: int, base: str) -> str:
    return with_views(f"""
SELECT asin, merchant_sku,
       format('{{:,}}', total_returns) AS total_returns_text,
       COALESCE(format('{{:,}}', total_sold), '') AS total_sold_text,
       COALESCE(printf('%.2f%%', return_pct), 'N/A') AS return_pct_text,
       '{base}' || asin AS product_link
FROM top""", _top_cte(year, n))


def monthly_series_json() -> str:
    slots = ", ".join(m.lower() for m in MONTHS_SQL)
    return with_views(f"""
SELECT '{{' || string_agg('"' || CAST(year AS VARCHAR) || '":[' ||
       array_to_string([{slots}], ',') || ']', ',' ORDER BY year) || '}}' AS series_json
FROM ({_slots()}) p""")


# The same returns with mixed spelling: quantities divisible by 5 show the
# SKU with e-acute for 'e', other odd quantities in upper case; quantities
# divisible by 3 show the ASIN in lower case.
MIXED_CASE_RETURNS = """,
returns AS (
  SELECT * REPLACE (
    CASE WHEN return_quantity % 5 = 0 THEN replace(merchant_sku, 'e', chr(233))
         WHEN return_quantity % 2 = 1 THEN upper(merchant_sku) ELSE merchant_sku END AS merchant_sku,
    CASE WHEN return_quantity % 3 = 0 THEN lower(asin) ELSE asin END AS asin)
  FROM returns_as_loaded
),
sales AS ("""


# Returns with gaps: quantities divisible by 7 have an unknown month, by 11 no
# ASIN, by 13 a blank SKU.
RETURNS_WITH_GAPS = """,
returns AS (
  SELECT * REPLACE (
    CASE WHEN return_quantity % 7 = 0 THEN 'Smarch' ELSE month END AS month,
    CASE WHEN return_quantity % 7 = 0 THEN NULL ELSE month_no END AS month_no,
    CASE WHEN return_quantity % 11 = 0 THEN NULL ELSE asin END AS asin,
    CASE WHEN return_quantity % 13 = 0 THEN '' ELSE merchant_sku END AS merchant_sku)
  FROM returns_as_loaded
),
sales AS ("""

# Returns whose SKUs have blanks around them: even quantities spaces, those
# divisible by 3 a tab before.
PADDED_RETURNS = """,
returns AS (
  SELECT * REPLACE (
    CASE WHEN return_quantity % 2 = 0 THEN '  ' || merchant_sku || ' '
         WHEN return_quantity % 3 = 0 THEN chr(9) || merchant_sku ELSE merchant_sku END AS merchant_sku)
  FROM returns_as_loaded
),
sales AS ("""


def _over(sql: str, returns: str) -> str:
    out = sql.replace("\nreturns AS (\n", "\nreturns_as_loaded AS (\n", 1)
    return out.replace(",\nsales AS (", returns, 1)


def mixed_case(sql: str) -> str:
    """Rewrite a plan's SQL to read the mixed-case returns."""
    return _over(sql, MIXED_CASE_RETURNS)


def with_gaps(sql: str) -> str:
    return _over(sql, RETURNS_WITH_GAPS)


def padded(sql: str) -> str:
    return _over(sql, PADDED_RETURNS)
