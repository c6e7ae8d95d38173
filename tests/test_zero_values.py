"""Queries on tables made for the case against their SQL: events of value zero."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from netpanel.plans import catalogue
from test_queries import key, same

DAILY_QUERIES = """fill_variants log_fill log_replace_ffill log_replace_interpolate log_replace_mean log_replace_min log_replace_zero
log_vola_load replace_values normalized_vola_index daily_aggregates""".split()


def both(spark, sf, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    q = catalogue()[name]
    return sorted((tuple(r) for r in q.run(spark, sf).collect()), key=key), sorted(con.execute(q.sql).fetchall(), key=key)


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("zeros"))
    day = lambda d: dt.datetime(2024, 1, d, 9)
    rows = [
        (1, day(1), 2.0), (1, day(1), 3.0), (1, day(2), 0.0), (1, day(2), 4.0), (1, day(3), 0.0), (1, day(4), 5.0), (1, day(5), 1.0), (1, day(5), 7.0),
        (2, day(1), 1.0), (2, day(1), 9.0), (2, day(3), 2.0), (2, day(3), 2.5), (2, day(5), 6.0), (3, day(2), 0.0), (3, day(4), 8.0), (3, day(4), 8.5),
    ]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.mark.parametrize("name", DAILY_QUERIES)
def test_days_with_a_zero_value_have_an_infinite_range(name, spark, zeros):
    got, want = both(spark, zeros, name, "events")
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))] == []
