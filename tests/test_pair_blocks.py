"""Moments of all pairs from blocks: against numpy with holes, over several blocks, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netpanel.operators import panel as P
from netpanel.plans import catalogue


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 12)) + 5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:6] = rng.normal(size=(6, 12))  # complete
    x[7, 1:], x[8] = np.nan, np.nan  # one value, none
    x[9] = 2.0  # constant
    rows = [(k, t, float(x[k, t]) if x[k, t] == x[k, t] else None) for k in range(40) for t in range(12)]
    return x, spark.createDataFrame(rows, "permno long, date int, x double")


def plain(a, b):
    both = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[both], b[both]
    if not len(a):
        return None
    cov = float(np.cov(a, b)[0, 1]) if len(a) > 1 else None
    return (float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 1e-9 and b.std() > 1e-9 else None, cov)


@pytest.mark.parametrize("block", [None, 7])
@pytest.mark.parametrize("upper", [False, True])
def test_moments_equal_numpy(panel, upper, block):
    x, df = panel
    got = {(r.i, r.j): (r.corr, r.cov) for r in P.pair_moments(df, "x", "permno", "date", upper=upper, block=block).collect()}
    want = {(i, j): plain(x[i], x[j]) for i in range(40) for j in range(40) if i < j or not upper}
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys()
    for k, (corr, cov) in want.items():
        assert got[k][0] == (None if corr is None else pytest.approx(corr, abs=1e-9)) and got[k][1] == (None if cov is None else pytest.approx(cov, abs=1e-9))


@pytest.mark.parametrize("block", [None, 7])
def test_mean_correlation_equals_numpy(panel, block):
    x, df = panel
    want = [plain(x[i], x[j]) for i in range(40) for j in range(i + 1, 40)]
    want = np.mean([w[0] for w in want if w and w[0] is not None])
    assert P.mean_correlation(df, "x", block=block).first()["mean"] == pytest.approx(want, abs=1e-10)
    assert P.mean_correlation(df.limit(0), "x", block=block).first()["mean"] is None


def test_a_series_travels_a_bounded_number_of_times(spark):
    n = 20_000  # 79 blocks of 256: each row went to all of them, on both sides
    df = spark.range(n).select(F.col("id").alias("permno"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("date"), F.rand(1).alias("x"))
    assert P._block_pairs(df, "x", "permno", "date", 0, None).count() <= n * (P.BLOCKS + 2)


@pytest.mark.parametrize("moment", [P.correlations, P.covariances])
def test_both_rows_of_a_pair_share_their_bytes_on_disk(spark, tmp_path, moment):
    n = 1024
    df = spark.range(n).select(F.col("id").alias("permno"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("date")).withColumn("x", F.rand(2))
    moment(df, "x").write.parquet(out := f"{tmp_path}/out")
    got = spark.read.parquet(out)
    assert got.count() == n * n == got.select("i", "j").distinct().count()
    # a value takes 8 bytes; tiles on the diagonal, a quarter of the pairs here, have it twice
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 6 * n * n


@pytest.mark.parametrize("name", ["corr_matrix", "cov_matrix", "avg_corr"])
def test_the_panel_is_made_once(spark, name):
    plan = catalogue()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan  # it was summed up from the rows once for its size and again for its copies


def test_a_large_panel_puts_little_more_on_disk_than_itself(spark):
    n, dates = 20_000, 4
    df = spark.range(n).select(F.col("id").alias("permno"), F.explode(F.sequence(F.lit(1), F.lit(dates))).alias("date"), F.rand(1).alias("x"))
    rows = P._block_pairs(df, "x", "permno", "date", 0, None)
    assert n < rows.count() <= 18 * n
    assert rows.where("t <> array_sort(t)").count() == 0
