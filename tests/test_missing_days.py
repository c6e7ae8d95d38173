"""Queries on events without a day or a user against their SQL: the dense panel keeps the missing day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_queries import same
from test_zero_values import both

SHARED = "fill_variants ffill bfill ffill_limit1 densify rolling_std_lag21 event_window last_mcap_ffill1 any_missing".split()
DENSE_QUERIES = "log_fill log_replace_ffill log_replace_interpolate log_replace_mean log_replace_min log_replace_zero log_vola_load".split()


@pytest.fixture(scope="module")
def missing(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("missing"))
    at = lambda d: None if d is None else dt.datetime(2024, 1, d, 9)
    rows = [
        (1, 1, 2.0), (1, 1, 3.0), (1, 2, 5.0), (1, 4, 4.0), (1, 4, 9.0), (1, None, 1.0), (1, None, 8.0), (2, 1, None), (2, 2, 6.0), (2, 2, 7.0),
        (3, 3, 2.0), (3, None, 2.5), (None, 2, 1.0), (None, 2, 4.0), (None, None, 3.0), (4, 1, 1.5), (4, 2, 2.5), (4, 3, 3.5), (4, 4, 4.5),
    ]
    df = spark.createDataFrame([(u, at(d), v) for u, d, v in rows], "user_id long, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.withColumn("event_type", F.lit("view")).write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.mark.parametrize("name", DENSE_QUERIES + SHARED)
def test_a_missing_day_stands_in_the_dense_panel(name, spark, missing):
    got, want = both(spark, missing, name, "events")
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))] == []
