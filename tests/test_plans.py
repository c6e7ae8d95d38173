"""What the optimiser makes of the plans: filters and columns reach the scans, joins and
shuffles are those that the operators mean."""

import re

from pyspark.sql import functions as F

from netpanel.functions import windows as X
from netpanel.operators import panel as P
from netpanel.plans import catalogue
from netpanel.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_reaches_the_scan(spark):
    p = plan(catalogue()["year_filter"].run(spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", p)
    schema = re.search(r"ReadSchema: struct<([^>]*l_shipdate[^>]*)>", p)[1]
    assert "l_comment" not in schema and len(schema.split(",")) <= 4


def test_columns_are_pruned(spark):
    p = plan(catalogue()["index_ew"].run(spark, SF))
    assert set(re.search(r"ReadSchema: struct<(.*?)>", p)[1].replace(":", ",").split(",")) >= {"l_suppkey", "l_shipdate", "l_discount", "l_tax"}
    assert "l_extendedprice" not in re.search(r"ReadSchema: struct<(.*?)>", p)[1]


def test_rolling_samples_need_no_shuffle(spark):
    df = spark.range(10).select(F.to_date(F.lit("2020-01-31")).alias("date"), "id")
    p = plan(P.rolling_samples(df, 12).select("sampling_date", "id"))
    assert "Generate explode" in p and "CartesianProduct" not in p
    assert p.count("Exchange hashpartitioning") == 0


def test_interval_join_is_a_hash_join(spark):
    p = plan(catalogue()["interval_join"].run(spark, SF))
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[permno", p) and "NestedLoop" not in p


def test_windows_of_one_asset_share_a_shuffle(spark):
    m = T.monthly(spark, SF)
    w = X.over_time()
    p = plan(m.withColumn("a", X.ffill("ret", w)).withColumn("b", X.pct_change(F.col("mcap"), w)).withColumn("c", F.lag("vol").over(w)))
    assert p.count("Exchange hashpartitioning(permno") <= 2


def test_no_python_in_relational_queries(spark):
    for name in ("outer_upsert", "selection_summary", "log_fill", "rolling_365d", "qcut5", "index_portfolio_both", "hac_mean_tstat", "connectedness"):
        assert not re.search("Python|Pandas|Arrow", plan(catalogue()[name].run(spark, SF))), name


def test_queries_over_whole_tables(spark):
    from netpanel.plans import catalogue
    from netpanel.sources import tables as T

    sf = "/root/testdata/sf0.01"
    c = catalogue()
    e = T.table(spark, sf, "events")
    for name in ("macro_chain_all", "outer_chain_all"):
        want = e.where("event_type = 'click'").agg({"value": "sum"}).first()[0]
        assert abs(c[name].run(spark, sf).agg({"click": "sum"}).first()[0] - want) < 1
    years = {r.y for r in T.monthly(spark, sf).selectExpr("year(date) AS y").distinct().collect()}
    assert {r.year for r in c["transpose_long"].run(spark, sf).select("year").distinct().collect()} == years
    wide = spark.createDataFrame([(1, k, float(200 - k)) for k in range(150)], "date int, permno long, mcap double")
    from netpanel.operators import panel as P

    assert P.top_sum(wide, "mcap", "mcap", 100, "date").first().top == sum(200 - k for k in range(100))


def test_partial_correlation_is_that_of_residuals(spark):
    import numpy as np

    from netpanel.plans import catalogue
    from netpanel.plans.ordered import regions

    sf = "/root/testdata/sf0.01"
    w = regions(spark, sf).toPandas().pivot(index="date", columns="permno", values="x").dropna()
    x = w.to_numpy(float) - w.to_numpy(float).mean(axis=0)
    for r in catalogue()["partial_corr_precision"].run(spark, sf).collect():
        i, j = w.columns.get_loc(r.i), w.columns.get_loc(r.j)
        rest = np.delete(x, [i, j], axis=1)
        a, b = (x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0] for k in (i, j))
        want = 1.0 if i == j else np.corrcoef(a, b)[0, 1]
        assert abs(r.pcorr - want) < 1e-5


def region_windows(spark):
    """The regional panel (date x permno), and its last 36-month window with that window's date."""
    from netpanel.plans.models import rolling
    from netpanel.plans.ordered import regions

    sf = "/root/testdata/sf0.01"
    w = regions(spark, sf).toPandas().pivot(index="date", columns="permno", values="x").sort_index().dropna()
    last = rolling(spark, sf).where("sampling_date = date'2000-06-30'").toPandas()
    return sf, w, last.pivot(index="date", columns="permno", values="x").sort_index().dropna()


def test_statistics_of_the_fitted_var_are_numpys(spark):
    import numpy as np

    from netpanel.plans import catalogue

    sf, w, _ = region_windows(spark)
    c, x = catalogue(), w.to_numpy(float)
    y, one = x[1:], np.ones((len(x) - 1, 1))

    def fit(*parts):
        z = np.hstack([one, *parts])
        return np.linalg.lstsq(z, y, rcond=None)[0]

    b = fit(x[:-1])
    resid = y - np.hstack([one, x[:-1]]) @ b
    got = c["var_residuals"].run(spark, sf).toPandas().pivot(index="date", columns="permno", values="resid").sort_index()
    assert np.allclose(got.to_numpy(), resid, atol=1e-5)
    tss = ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    r = c["var_r2"].run(spark, sf).first()
    var = y.var(axis=0, ddof=1)
    assert abs(r.equal - (1 - (resid**2).sum() / tss.sum())) < 1e-5
    assert abs(r.variance - (1 - ((resid**2).sum(axis=0) / var).sum() / (tss / var).sum())) < 1e-5
    f = x[1:].mean(axis=1, keepdims=True)
    g = fit(f, x[:-1])
    fp, vp = f @ g[1:2], x[:-1] @ g[2:]

    def squares(e):
        return ((e - e.mean(axis=0)) ** 2).sum()

    p = c["partial_r2"].run(spark, sf).first()
    assert abs(p.factors - (1 - squares(y - fp - vp) / squares(y - vp))) < 1e-5
    assert abs(p["var"] - (1 - squares(y - fp - vp) / squares(y - fp))) < 1e-5
    s = c["collect_var_cov"].run(spark, sf).toPandas().sort_values("permno")
    a = np.abs(b[1:].T) * (1 - np.eye(5))
    assert np.allclose(s["mean_in"], a.sum(axis=1) / 4, atol=1e-5) and np.allclose(s["mean_out"], a.sum(axis=0) / 4, atol=1e-5)
    assert np.allclose(s["var"], resid.var(axis=0, ddof=1), atol=1e-5)


def test_densities_are_counted_on_estimates(spark):
    import numpy as np

    from netpanel.functions import kernels as K
    from netpanel.plans import catalogue

    sf, _, w = region_windows(spark)
    c, at = catalogue(), "sampling_date = '2000-06-30'"
    s = np.cov(w.to_numpy(float), rowvar=False, ddof=0)
    cov, prec = K.glasso(s, 0.01)
    r = c["sparsity_stats"].run(spark, sf).where(at).first()
    upper = np.triu(np.ones((5, 5), bool))
    assert (r.prec_used, r.df_full) == (int((np.abs(prec[upper]) > 1e-8).sum()), 15)
    assert abs(r.cov_density - (np.abs(cov) > 1e-8).mean()) < 1e-6 and abs(r.prec_density - (np.abs(prec) > 1e-8).mean()) < 1e-6
    off = ~np.eye(5, dtype=bool)
    got = c["shrinkage"].run(spark, sf).where(at).first().shrinkage
    assert abs(got - (1 - np.abs(cov[off]).mean() / np.abs(s[off]).mean())) < 1e-5
    coefs = c["elastic_net"].run(spark, sf).where(f"{at} and term = 'lag1'").toPandas()["coef"].to_numpy()
    d, n = c["coef_density"].run(spark, sf).where(at).first(), c["df_stats"].run(spark, sf).where(at).first()
    assert len(coefs) == 25 and (d.n_used, n.df_used, n.df_full, n.n) == (int((coefs != 0).sum()), int((coefs != 0).sum()), 25, 5)


def test_two_way_effects_refuse_unbalanced_panels(spark):
    import pytest

    from netpanel.operators import regression as R

    rows = [(i, t, float(i * t % 7), float(i + t * t)) for i in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "permno long, date int, y double, x double")
    assert R.panel_ols(df, "y", "x", "both").count() == 1
    with pytest.raises(ValueError, match="balanced"):
        R.panel_ols(df.where("permno > 0 or date > 0"), "y", "x", "both")


def test_entry_point_passes_over_absence_only(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/netpanel", f"{tmp_path}/netpanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    show = "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.queries()) > 200)"

    def run():
        return subprocess.run([sys.executable, "-c", show], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)

    assert run().stdout.split() == ["0", "True"]
    os.mkdir(f"{tmp_path}/netpanel/llm")
    (tmp_path / "netpanel/llm/__init__.py").touch()
    (tmp_path / "netpanel/llm/queries.py").write_text("import no_such_module_anywhere\n")
    assert "no_such_module_anywhere" in run().stderr
