"""Statistics of searched fits against numpy on the rows."""

import numpy as np
import pytest

from netpanel.functions import kernels as K
from netpanel.operators import description as D
from netpanel.operators import models as E
from netpanel.operators import regression as R

N, T = 4, 120


def test_statistics_equal_those_of_the_rows(spark):
    rng = np.random.default_rng(11)
    f = rng.standard_normal(T)
    x = np.zeros((T, N))
    a = np.diag([0.6, 0.5, 0.3, 0.4]) + 0.2 * np.eye(N, k=1)
    for t in range(1, T):
        x[t] = 0.5 + a @ x[t - 1] + 0.7 * f[t] + rng.standard_normal(N)
    df = spark.createDataFrame([(1, t, k, float(x[t, k]), float(f[t])) for t in range(T) for k in range(N)], "w int, date int, permno long, x double, mkt double")
    grid, alphas = R.grid(spark, {"alpha": [0.5, 1.0], "lambdau": [0.01, 0.1]}), [0.001, 0.01, 0.1]
    got = {r.statistic: r.value for r in D.describe_search(df, grid, "w", alphas, ("mkt",), 4).collect()}
    found = E.net_moments(df, "w", 4, ("mkt",))
    first = E.first_points(found, "w", 4, factors=("mkt",))
    best = E.best_point(E.penalised_path(found, grid, "w", 4, first, factors=("mkt",)), "w")
    point = best.first()
    assert (got["lambda"], got["kappa"], got["var_cv_loss"]) == (point.lambdau, point.alpha, pytest.approx(point.mse))
    b = np.zeros((2 + N, N))
    for r in E.penalised_var(df, best, "w", first, factors=("mkt",)).collect():
        b[{"const": 0, "mkt": 1}.get(r.term, 2 + r.source), r.equation] = r.coef
    y, d = x[1:], np.column_stack([np.ones(T - 1), f[1:], x[:-1]])
    ols = np.linalg.lstsq(d, y, rcond=None)[0]
    var = lambda e: ((e - e.mean(axis=0)) ** 2).sum()
    for coef, end in ((b, ""), (ols, "_ols")):
        only_f, only_v = coef.copy(), coef.copy()
        only_f[2:], only_v[1] = 0, 0
        e, tss = y - d @ coef, var(y)
        assert got[f"var_r2{end}"] == pytest.approx(1 - (e**2).sum() / tss, rel=1e-6)
        for name, own, other in (("factors", only_f, only_v), ("spillovers", only_v, only_f)):
            assert got[f"var_component_r2_{name}{end}"] == pytest.approx(1 - var(y - d @ own) / tss, rel=1e-6)
            assert got[f"var_partial_r2_{name}{end}"] == pytest.approx(1 - var(e) / var(y - d @ other), rel=1e-6)
    m, mo = b[2:].T, ols[2:].T
    assert got["var_matrix_density"] == (m != 0).mean() and got["var_mean_abs_connection"] == pytest.approx(np.abs(m).mean())
    assert got["var_df_full"] == N * (2 + N) and got["var_df_used"] == np.count_nonzero(b[1:]) + N
    assert got["var_full_shrinkage"] == pytest.approx(1 - np.abs(m).mean() / np.abs(mo).mean(), rel=1e-6)
    assert got["var_full_factor_shrinkage"] == pytest.approx(1 - np.abs(b[1]).mean() / np.abs(ols[1]).mean(), rel=1e-6)
    assert 0 < got["var_train_loss"] < got["var_cv_loss"] * 1.5
    e = y - d @ b
    cov, prec = K.glasso(np.cov(e, rowvar=False, ddof=0), got["rho"])
    c = e - e.mean(axis=0)
    dense = np.mean([-0.5 * (N * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r)) for r in c])
    assert got["cov_mean_likelihood"] == pytest.approx(dense, rel=1e-6) and got["cov_mean_likelihood_sample_estimate"] >= got["cov_mean_likelihood"] - 1e-3
    assert got["cov_df_full"] == N * (N - 1) // 2 and got["cov_df_used"] == (np.count_nonzero(prec) - N) // 2 + N
    assert got["precision_density"] == (prec != 0).mean() and got["covar_full_shrinkage"] == pytest.approx(1 - np.abs(cov).mean() / np.abs(np.cov(e, rowvar=False)).mean(), rel=1e-5)
