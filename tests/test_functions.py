"""Hand-made fixtures for functions of panels."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netpanel.functions import columns as C
from netpanel.functions import windows as X
from netpanel.operators import indices as I
from netpanel.operators import panel as P
from netpanel.operators import sampling as S

N = None
# Data, fill series and the series whose logarithm is expected.
LOG_FILL = {
    "full_column": ([1, 1, 1], [2, 2, 2], [1, 1, 1]),
    "empty_column": ([N, N, N], [N, N, N], [N, N, N]),
    "zero_column": ([0, 0, 0], [2, 2, 2], [2, 2, 2]),
    "middle_zero": ([1, 0, 1], [2, 0, 2], [1, 2, 1]),
    "middle_empty": ([1, N, 1], [2, N, 2], [1, 2, 1]),
    "begin_zero": ([0, 1, 1], [0, 2, 2], [2, 1, 1]),
    "begin_empty": ([N, 1, 1], [N, 2, 2], [2, 1, 1]),
    "end_zero": ([1, 1, 0], [2, 2, 0], [1, 1, 2]),
    "end_empty": ([1, 1, N], [2, 2, N], [1, 1, 1]),
    "middle_zeros": ([1, 0, 0, 1], [2, 0, 0, 2], [1, 2, 2, 1]),
    "middle_empties": ([1, N, N, 1], [2, N, N, 2], [1, 2, 2, 1]),
}


def test_log_fill(spark):
    rows = [(k, t, float(d) if d is not None else None, float(f) if f is not None else None) for k, (ds, fs, _) in LOG_FILL.items() for t, (d, f) in enumerate(zip(ds, fs, strict=True))]
    df = spark.createDataFrame(rows, "permno string, date int, d double, f double")
    got = {(r.permno, r.date): r.log_x for r in X.log_fill(df, "d", "f").collect()}
    for k, (_, _, es) in LOG_FILL.items():
        for t, e in enumerate(es):
            assert got[k, t] == (None if e is None else pytest.approx(math.log(e))), (k, t)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v) if v is not None else None) for i, v in enumerate(values)], "permno string, date int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize(("method", "want"), [("min", [1, 2, 1, 1, 4, 1]), ("zero", [1, 2, 1, 1, 4, 1]), ("ffill", [1, 2, 2, 2, 4, 4]), ("interpolate", [1, 2, 2 ** (4 / 3), 2 ** (5 / 3), 4, 4])])
def test_log_replace(spark, method, want):
    got = column(X.log_replace(series(spark, [1, 2, 0, 0, 4, 0]), "x", method), "log_x")
    assert [math.exp(g) for g in got] == pytest.approx(want)


def test_log_replace_mean_and_unknown(spark):
    got = column(X.log_replace(series(spark, [0, 4, 16]), "x", "mean"), "log_x")
    assert math.exp(got[0]) == pytest.approx(8)
    with pytest.raises(ValueError):
        X.log_replace(series(spark, [1]), "x", "cubic")


def test_fills_over_a_two_day_gap(spark):
    df, w = series(spark, [1, None, None, 4, None]), X.over_time()
    assert column(df.withColumn("y", X.ffill("x", w, 1)), "y") == [1, 1, None, 4, 4]
    assert column(df.withColumn("y", X.ffill("x", w)), "y") == [1, 1, 1, 4, 4]
    assert column(df.withColumn("y", X.bfill("x", w)), "y") == [1, 4, 4, 4, None]


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None), (5, 1.0)], "permno int, x double").withColumn("date", F.lit(1))
    got = {r.permno: r.r for r in df.withColumn("r", X.average_rank(F.col("x"), "date")).collect()}
    assert got == {3: 1.0, 1: 2.5, 2: 2.5, 5: 4.0, 4: None}


def test_quantile_edges_equal_to_data_points(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 12)], "permno int, x double").withColumn("date", F.lit(1))
    got = [r.bucket for r in X.quantile_bucket(df, "x", 5, ["date"]).orderBy("permno").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_interval_boundaries(spark):
    facts = spark.createDataFrame([(1, d) for d in ("2020-01-01", "2020-01-31", "2020-02-01", "2019-12-31")], "permno int, date string").withColumn("date", F.to_date("date"))
    names = spark.createDataFrame([(1, "2020-01-01", "2020-01-31", "x")], "permno int, a string, b string, name string").withColumns({"a": F.to_date("a"), "b": F.to_date("b")})
    got = {str(r.date): r.name for r in P.interval_join(facts, names, "permno", "date", "a", "b").collect()}
    assert got == {"2020-01-01": "x", "2020-01-31": "x", "2020-02-01": None, "2019-12-31": None}


def test_duplicate_names(spark):
    df = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (4, None), (5, None)], "o int, ticker string").withColumn("sd", F.lit(1))
    got = {r.o: r.t for r in df.withColumn("t", X.suffix_duplicates(F.col("ticker"), ["sd"], "o")).collect()}
    assert got == {1: "X.A", 2: "X.B", 3: "Y", 4: None, 5: None}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 10.0, 1.0), (2, 20.0, None)], "k int, a double, b double")
    new = spark.createDataFrame([(2, 5.0), (3, 7.0), (4, None)], "k int, b double")
    got = {r.k: (r.a, r.b) for r in P.upsert(old, new, ["k"]).collect()}
    assert got == {1: (10.0, None), 2: (20.0, 5.0), 3: (None, 7.0)}


def test_scalars(spark):
    df = spark.createDataFrame([(None, None, 0.0, 5.0), (0.1, None, 2.0, 2.0), (0.1, -0.5, 8.0, 2.0)], "r double, d double, hi double, lo double")
    got = df.select(C.delisting_adjusted(F.col("r"), F.col("d")).alias("r"), C.range_variance(F.col("hi"), F.col("lo"), True).alias("v")).collect()
    assert [g.r for g in got] == [None, pytest.approx(0.1), pytest.approx(-0.45)]
    assert [g.v for g in got] == [None, 0, pytest.approx(0.3607 * math.log10(4) ** 2)]
    codes = spark.createDataFrame([(c,) for c in (99, 100, 999, 3711, 3714, 3693, 6800, 9729, 9990)], "c int")
    assert [r[0] for r in codes.select(C.sic_division(F.col("c"))).collect()][:3] == ["N/A", "Agriculture, Forestry and Fishing", "Agriculture, Forestry and Fishing"]
    assert {r.c: r.ff_ticker for r in C.with_twelve_sectors(codes, "c").collect()} == {99: "Other", 100: "NoDur", 999: "NoDur", 3711: "Durbl", 3714: "Durbl", 3693: "Hlth", 6800: "Money", 9729: "Other", 9990: "Other"}
    day = spark.sql("select date'2020-01-31' as d, date'2020-03-15' as e")
    assert [str(x) for x in day.select(C.month_end(F.col("d"), 1), C.back_start(F.to_date(F.lit("2021-02-28")), 12), C.months_between(F.col("d"), F.col("e"))).first()] == ["2020-02-29", "2020-03-01", "2"]
    assert day.select(C.title_case(F.lit("AT&T CORP of ohio")), C.initials(F.lit("Big Blue Co"))).first()[:] == ("At&T Corp Of Ohio", "BBC")


def test_weights_with_nulls_and_zero_sums(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 6.0), (2, 1, 0.0), (2, 2, 0.0)], "date int, permno int, x double")
    got = {(r.date, r.permno): r.weight for r in I.long_weights(df, "x").collect()}
    assert got == {(1, 1): 0.25, (1, 2): None, (1, 3): 0.75, (2, 1): None, (2, 2): None}
    with pytest.raises(ValueError):
        I.leg(df.withColumn("weight", F.lit(1)), "sideways")


def test_residual_weights_do_not_see_scale(spark):
    df = spark.createDataFrame([(1, k, float(k + 1)) for k in range(5)], "date int, permno int, x double")
    a = [r.weight for r in I.residual_weights(df, "x", leverage=2.0).orderBy("permno").collect()]
    b = [r.weight for r in I.residual_weights(df.withColumn("x", F.col("x") * 7), "x", leverage=2.0).orderBy("permno").collect()]
    assert a == pytest.approx(b) and sum(map(abs, a)) == pytest.approx(2) and sum(a) == pytest.approx(0)


def test_company_with_two_tied_securities(spark):
    rows = [("2020-01-31", 1, 10, 1.0, 0.5), ("2020-01-31", 2, 10, 2.0, 0.5), ("2020-01-31", 3, 10, 4.0, 0.1), ("2020-01-31", 4, 20, 8.0, None)]
    df = spark.createDataFrame(rows, "date string, permno int, permco int, mcap double, var double").withColumn("date", F.to_date("date")).withColumn("sampling_date", F.col("date"))
    got = {r.permno: (r.mcap, r.permno_mcap) for r in S.representative(df).collect()}
    assert got == {1: (7.0, 1.0), 2: (7.0, 2.0)}


def test_unknown_rank_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, "A", 1.0)], "sampling_date int, permno int, ticker string, mean_mcap_rank double")
    assert S.select_largest(df, 1).count() == 1
    with pytest.raises(ValueError):
        S.select_largest(df, 1, "last", "valvola")


def test_rolling_samples_hold_each_month_twelve_times(spark):
    df = spark.sql("select explode(sequence(date'2020-01-31', date'2022-12-31', interval 1 month)) as d").select(F.last_day("d").alias("date"))
    n = P.rolling_samples(df, 12).groupBy("sampling_date").count()
    assert n.where("sampling_date >= date'2020-12-31' and count <> 12").count() == 0
    assert P.own_month(P.rolling_samples(df, 12)).where("sampling_date <> date").count() == 0
    w = Window.partitionBy("sampling_date")
    ahead = P.forward_samples(df, 3).withColumn("n", F.count("date").over(w))
    assert ahead.where("date <= sampling_date").count() == 0 and ahead.agg(F.max("n")).first()[0] == 3
