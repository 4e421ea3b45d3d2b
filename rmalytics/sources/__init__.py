"""Sources and sinks: report files, Parquet tables, CSV export, driver tables."""
