"""Top returned SKUs of a year with the units sold of their ASIN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.functions.keys import key_of, spelling
from rmalytics.functions.rates import return_rate


def top_returned(returns: DataFrame, sales: DataFrame, year: int, n: int = 50,
                 fold_case: bool = True) -> DataFrame:
    """``n`` (asin, merchant_sku) groups with most units returned in ``year``.

    Columns: asin, merchant_sku, total_returns, total_sold (units sold of the
    whole ASIN in that year; NULL if none), return_pct (half-even, NULL
    without sales). Ties break by asin, merchant_sku (their keys).

    Plan: returns (pruned to the year's partition) -> partial/final
    aggregate on the keys (numeric buffers: HashAggregate) -> top-n. Only
    then are sales touched, and only for the <= n ASINs kept: the n keys
    semi-join the year's sales before their aggregate. How each join is done
    is left to adaptive execution, which sees the real size of the winners.
    With ``fold_case`` the displayed spellings are looked up for the <= n
    winners only.
    """
    r = (returns.filter(F.col("year") == year)
         .select(key_of(returns, "asin", fold_case).alias("asin_key"),
                 key_of(returns, "merchant_sku", fold_case).alias("sku_key"),
                 "asin", "merchant_sku", "return_quantity"))
    per_sku = (r.groupBy("asin_key", "sku_key")
               .agg(F.sum("return_quantity").cast("bigint").alias("total_returns")))
    order = [F.desc("total_returns"), F.asc("asin_key"), F.asc("sku_key")]
    top = per_sku.orderBy(*order).limit(n)

    winners = top.select(F.col("asin_key").alias("w_asin"))
    sold = (sales.filter(F.col("year") == year)
            .select(key_of(sales, "asin", fold_case).alias("asin_key"), "quantity")
            .join(winners, F.col("asin_key") == F.col("w_asin"), "left_semi")
            .groupBy("asin_key")
            .agg(F.sum("quantity").cast("bigint").alias("total_sold")))
    out = top.join(sold, "asin_key", "left")

    if fold_case:
        w = top.select(F.col("asin_key").alias("w_asin"), F.col("sku_key").alias("w_sku"))
        spelled = (r.join(w, F.col("asin_key").eqNullSafe(F.col("w_asin"))
                          & F.col("sku_key").eqNullSafe(F.col("w_sku")), "left_semi")
                   .groupBy(F.col("asin_key").alias("s_asin"), F.col("sku_key").alias("s_sku"))
                   .agg(spelling("asin").alias("asin"), spelling("merchant_sku").alias("merchant_sku")))
        out = out.join(spelled, F.col("asin_key").eqNullSafe(F.col("s_asin"))
                       & F.col("sku_key").eqNullSafe(F.col("s_sku")), "left")
    else:
        out = out.withColumn("asin", F.col("asin_key")).withColumn("merchant_sku", F.col("sku_key"))

    return (out.select(
                "asin", "merchant_sku", "total_returns", "total_sold",
                return_rate(F.col("total_returns"), F.col("total_sold"), "half_even")
                .alias("return_pct"), "asin_key", "sku_key")
            .orderBy(*order)
            .drop("asin_key", "sku_key"))
