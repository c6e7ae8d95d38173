"""Rounding of values whose digits end at half: the panel rounds as its SQL does."""

import datetime as dt

from pyspark.sql import functions as F

from netpanel.functions import columns as C
from test_queries import same
from test_zero_values import both

# Lows whose variance against a high of 1e300 has a scaled value at half.
LOWS = [98.04, 92.73, 91.38, 90.44, 83.05, 70.76, 65.05, 64.9, 59.25, 57.87]


def test_wide_ranges_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 9)
    rows = [(i, at, v) for i, lo in enumerate(LOWS) for v in (lo, 1e300)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "replace_values", "events")
    assert len(got) == len(want) == len(LOWS)
    assert [(a, b) for a, b in zip(got, want) if not (all(map(same, a, b)) and a[2] == b[2])] == []


def test_round_scaled(spark):
    values = [0.125, -0.125, 2.0, 169838.09290801824, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.y for r in df.select("i", C.round_scaled(F.col("x"), 2).alias("y")).orderBy("i").collect()]
    assert got[:5] == [0.13, -0.13, 2.0, 169838.09, float("inf")] and got[5] != got[5] and got[6] is None
    assert df.where("i = 3").select(C.round_scaled(F.col("x"), 10).alias("y")).first().y == 169838.0929080183
