import datetime as dt

import pytest
from pyspark.sql import functions as F

from netpanel.sources import estimates as S

DAYS = [dt.date(2001, m, 28) for m in range(1, 7)]


def panel(spark, changed=None, rows=20):
    made = [(d, k, float(k * (i + 1)) + (0.5 if d == changed and k == 3 else 0.0), None if k == 5 else float(k)) for i, d in enumerate(DAYS) for k in range(rows)]
    return spark.createDataFrame(made, "day date, k long, x double, y double")


@pytest.fixture
def fit():
    seen = []

    def run(df):
        seen.append(sorted(r.day for r in df.select("day").distinct().collect()))
        return df.groupBy("day").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 200")

    run.seen = seen
    return run


def rows(df):
    return sorted((r.day, r.total, r.n) for r in df.collect())


def expected(df):
    return sorted((r.day, r.total, r.n) for r in df.groupBy("day").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n")).collect() if r.total > 200)


def test_a_second_run_fits_nothing_and_a_changed_window_is_fitted_alone(spark, tmp_path, fit):
    path = f"file://{tmp_path}/stored"
    df = panel(spark)
    assert rows(S.read_or_estimate(df, "day", path, fit)) == expected(df)
    assert fit.seen == [DAYS]
    again, fitted = S.refresh(df.orderBy(F.desc("k")).repartition(3), "day", path, fit)
    assert rows(again) == expected(df) and fitted.isEmpty() and len(fit.seen) == 1  # also the window without estimates
    other = panel(spark, changed=DAYS[2])
    now, fitted = S.refresh(other, "day", path, fit)
    assert rows(now) == expected(other) and [r.day for r in fitted.collect()] == [DAYS[2]] and fit.seen[1:] == [[DAYS[2]]]
    assert now.schema["day"].dataType == df.schema["day"].dataType
    fewer = other.where(F.col("day") != DAYS[3])
    assert rows(S.read_or_estimate(fewer, "day", path, fit)) == expected(fewer) and len(fit.seen) == 2


def test_settings_make_everything_stale_and_a_window_may_lose_its_estimates(spark, tmp_path, fit):
    path = f"file://{tmp_path}/stored"
    df = panel(spark)
    S.read_or_estimate(df, "day", path, fit, "grid 1")
    assert len(S.refresh(df, "day", path, fit, "grid 2")[1].collect()) == len(DAYS)
    less = df.where((F.col("day") != DAYS[4]) | (F.col("k") < 2))
    assert rows(S.read_or_estimate(less, "day", path, fit, "grid 2")) == expected(less)
    assert DAYS[4] not in [r[0] for r in expected(less)]


def test_a_lost_job_leaves_stale_windows_not_wrong_ones(spark, tmp_path, fit):
    path = f"file://{tmp_path}/stored"
    S.read_or_estimate(panel(spark), "day", path, fit)
    other = panel(spark, changed=DAYS[5])
    real = S.write
    try:
        S.write = lambda df, to, by=(): real(df, to, by) if to.endswith("estimates") else (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            S.refresh(other, "day", path, fit)
    finally:
        S.write = real
    # the digest still is the old input's, the estimates are the new one's: neither is taken
    assert rows(S.read_or_estimate(panel(spark), "day", path, fit)) == expected(panel(spark)) and fit.seen[2:] == [[DAYS[5]]]
    assert rows(S.read_or_estimate(other, "day", path, fit)) == expected(other)


def test_digests_see_repeats_and_the_place_of_nulls(spark):
    schema = "w string, a long, b long"
    digest = lambda made: {r.w: r.input_digest for r in S.digests(spark.createDataFrame(made, schema), "w").collect()}
    base = digest([("01", 1, None), ("1", None, 1)])
    assert base["01"] != base["1"]
    assert digest([("01", 1, None)] * 2)["01"] != base["01"] and digest([("01", 1, None)] * 3)["01"] != base["01"]
    assert digest([(None, 1, 1)]) == {}


def test_text_keys_keep_their_zeros_and_no_rows_give_no_estimates(spark, tmp_path):
    df = spark.createDataFrame([("01", 1.0), ("1", 2.0)], "w string, x double")
    take = lambda d: d.groupBy("w").agg(F.sum("x").alias("s"))
    for _ in range(2):
        assert {(r.w, r.s) for r in S.read_or_estimate(df, "w", f"file://{tmp_path}/t", take).collect()} == {("01", 1.0), ("1", 2.0)}
    assert S.read_or_estimate(df.limit(0), "w", f"file://{tmp_path}/u", take).count() == 0
