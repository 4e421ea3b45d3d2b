"""CSV export sink: header, comma separated, minimal quoting, NULL -> empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rmalytics.schemas import EXPORT_HEADERS

CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',      # a quote inside a field is doubled
    "nullValue": "",
    "emptyValue": "",
    "lineSep": "\r\n",
    # the writer trims fields unless told not to
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_export_csv(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> str:
    """Write the export as CSV part files under ``path`` (one per task, each
    with the header row). The data stays distributed: no single-task
    funnel; concatenating the parts is the reader's job."""
    headers = EXPORT_HEADERS if headers is None else headers
    out = df.select(*[df[c].alias(headers.get(c, c)) for c in df.columns])
    out.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
    return path


def read_export_csv(spark: SparkSession, path: str, headers: dict[str, str] | None = None) -> DataFrame:
    headers = EXPORT_HEADERS if headers is None else headers
    back = {v: k for k, v in headers.items()}
    df = spark.read.options(header="true", sep=",", quote='"', escape='"',
                            multiLine="true", inferSchema="false", ignoreLeadingWhiteSpace="false",
                            ignoreTrailingWhiteSpace="false").csv(path)
    return df.select(*[df[f"`{c}`"].alias(back.get(c, c)) for c in df.columns])
