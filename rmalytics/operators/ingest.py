"""Ingest projections: report rows (all strings) -> typed table rows.

Every check is a column expression; a row's problems are collected in an
``_errors`` array, so that one bad row fails the whole load with nothing
written (policy ``fail``) or bad rows are split off (policy ``quarantine``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rmalytics.functions.dates import month_name, purchase_month_year, report_month_year
from rmalytics.functions.numbers import blank_to_zero_float, strict_int, text_flag
from rmalytics.schemas import (
    RETURNS_HEADERS,
    RETURNS_INT_HEADERS,
    SALES_COLUMNS,
    SALES_FLAG_HEADERS,
    SALES_FLOAT_HEADERS,
    SALES_RENAME,
    snake,
)


class ReportRowError(ValueError):
    """Some rows could not be loaded; nothing was written."""


_SEP = "; "


def _errors(*checks: tuple[Column, str]) -> Column:
    """The messages of the failed checks, as an array (empty when none).

    Built with ``concat_ws`` (skips NULLs) and ``split``, both code-generated,
    rather than a higher-order ``filter``, which is evaluated interpreted.
    """
    text = F.concat_ws(_SEP, *[F.when(bad, F.lit(msg)) for bad, msg in checks])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _SEP))


def prepare_returns(raw: DataFrame) -> DataFrame:
    """Keep the 32 report columns (snake case), derive month/year, stamp time.

    Blank text stays '' (Spark reads an empty field as NULL). Quantities must
    be integers; the request date must be ``D-Mon-YY[YY]``.
    """
    text = {h: F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in RETURNS_HEADERS}
    _, year, number = report_month_year(F.col("`Return request date`"))
    whole = {h: f"_{snake(h)}" for h in RETURNS_INT_HEADERS}
    raw = _with_parsed(raw, {"_year": year, "_month_no": number, **{c: strict_int(F.col(f"`{h}`")) for h, c in whole.items()}})
    cols = [(F.col(whole[h]) if h in whole else text[h]).alias(snake(h)) for h in RETURNS_HEADERS]
    return raw.select(
        *cols,
        month_name(F.col("_month_no")).alias("month"),
        F.col("_year").alias("year"),
        F.col("_month_no").alias("month_no"),
        F.localtimestamp().alias("last_updated"),
        _errors(
            (F.col("_month_no").isNull(), "bad Return request date"),
            *[(F.col(c).isNull(), f"bad {h}") for h, c in whole.items()],
        ).alias("_errors"),
        *_source_file(raw),
    )


def _with_parsed(raw: DataFrame, parsed: dict[str, Column]) -> DataFrame:
    """``raw`` with parsed columns, each worked out once for a row.

    They pass through a generator of one row, which the optimizer doesn't take
    apart: plain columns would be parsed anew in every expression and filter
    that uses them.
    """
    once = raw.select("*", *[c.alias(f"_{name}") for name, c in parsed.items()])
    row = F.struct(*[F.col(f"_{name}").alias(name) for name in parsed])
    return once.select(*[once[f"`{c}`"] for c in raw.columns], F.inline(F.array(row)))


def prepare_sales(renamed: DataFrame) -> DataFrame:
    """39 sales columns (already renamed to snake case) -> typed row."""
    floats = {SALES_RENAME[h] for h in SALES_FLOAT_HEADERS}
    flags = {SALES_RENAME[h] for h in SALES_FLAG_HEADERS}
    _, year, number = purchase_month_year(F.col("purchase_date"))
    renamed = _with_parsed(renamed, {"_year": year, "_month_no": number, "_quantity": strict_int(F.col("quantity"))})
    cols = []
    for c in SALES_COLUMNS:
        if c in floats:
            e = blank_to_zero_float(F.col(c))
        elif c in flags:
            e = text_flag(F.col(c))
        elif c == "quantity":
            e = F.col("_quantity")
        else:
            e = F.coalesce(F.col(c), F.lit(""))
        cols.append(e.alias(c))
    return renamed.select(
        *cols,
        month_name(F.col("_month_no")).alias("month"),
        F.col("_year").alias("year"),
        F.col("_month_no").alias("month_no"),
        F.localtimestamp().alias("last_updated"),
        _errors(
            (F.col("_month_no").isNull(), "bad purchase-date"),
            (F.col("_quantity").isNull(), "bad quantity"),
        ).alias("_errors"),
        *_source_file(renamed),
    )


def _source_file(raw: DataFrame) -> list[Column]:
    """The file a row came from, where the scan tells it (kept with rejected rows)."""
    return [F.col("_file")] if "_file" in raw.columns else []


ROW_ERROR_TAG = "rmalytics: rows cannot be loaded: "


def enforce(prepared: DataFrame, on_error: str = "fail"):
    """Apply the load policy.

    ``fail``: the rows pass through a guard that raises on the first row
    with problems, so the job that writes them fails and Spark's commit
    protocol leaves nothing behind: one pass, no separate validation scan.
    The error surfaces when the DataFrame is written (``ingest_*`` turn it
    into :class:`ReportRowError`).
    ``quarantine``: return ``(good, bad)``; ``bad`` keeps ``_errors``.
    """
    if on_error == "quarantine":
        bad = prepared.filter(F.size("_errors") > 0)
        good = prepared.filter(F.size("_errors") == 0).drop("_errors", "_file")
        return good, bad
    if on_error != "fail":
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    msg = F.concat(F.lit(ROW_ERROR_TAG), F.array_join("_errors", "; "))
    # a filter, not a column: column pruning cannot drop it whatever the
    # caller selects afterwards
    guard = F.when(F.size("_errors") > 0, F.raise_error(msg).isNull()).otherwise(F.lit(True))
    return prepared.filter(guard).drop("_errors", "_file")


def raise_row_error(exc: Exception) -> None:
    """Re-raise a Spark failure caused by the ``fail`` guard as ReportRowError."""
    text = str(exc)
    i = text.find(ROW_ERROR_TAG)
    if i < 0:
        raise exc
    detail = text[i + len(ROW_ERROR_TAG):].split("\n", 1)[0]
    raise ReportRowError(f"a row cannot be loaded ({detail.strip()}); nothing written") from exc
