import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]")
         .appName("rmalytics-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rmalytics-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """The golden mini dataset of FIXTURES.md section 3."""
    import datetime as dt

    from pyspark.sql import functions as F

    from rmalytics.functions.dates import month_number

    rows = [
        ("A1", "S1", 2, "Too small", "January", 2023),
        ("A1", "S1", 1, "Too small", "January", 2024),
        ("A1", "S2", 3, "Defective", "March", 2024),
        ("A2", "T1", 1, "Defective", "March", 2024),
        ("A2", "T1", 5, "", "May", 2025),
    ]
    r = spark.createDataFrame(
        rows, "asin string, merchant_sku string, return_quantity int, return_reason string, "
              "month string, year int")
    r = r.withColumn("month_no", month_number(F.col("month"))) \
         .withColumn("last_updated", F.lit(dt.datetime(2025, 5, 31, 12, 0)).cast("timestamp_ntz"))
    s = spark.createDataFrame([("A1", 4, 2023), ("A1", 3, 2024), ("A3", 7, 2024)],
                              "asin string, quantity int, year int")
    return r, s
