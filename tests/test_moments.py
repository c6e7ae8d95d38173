"""Models of several lags from moments against numpy on the rows themselves."""

import numpy as np
import pytest

from netpanel.functions import kernels as K
from netpanel.operators import models as E
from netpanel.operators import moments as MO


@pytest.fixture(scope="module")
def panel(spark):
    """(x, f, table): 70 series (more than a block) on 64 dates and a factor; one date misses a series."""
    rng = np.random.default_rng(11)
    x = np.zeros((64, 70))
    f = rng.standard_normal(64)
    for t in range(2, 64):
        x[t] = 0.4 * x[t - 1] + 0.2 * x[t - 2] + 0.3 * f[t] + rng.standard_normal(70)
    x += np.arange(70)
    rows = [(1, t, k, float(x[t, k]), float(f[t])) for t in range(64) for k in range(70)] + [(1, 64, 3, 1.0, 0.5), (2, 0, 0, 1.0, 1.0), (2, 1, 0, 2.0, 1.0)]
    return x, f, spark.createDataFrame(rows, "w int, date int, permno long, x double, mkt double").repartition(5)


def own_rows(x, f, lags):
    z, g = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), (f - f.mean()) / f.std(ddof=1)
    return np.column_stack([g[lags:], *[z[lags - k : len(z) - k] for k in range(1, lags + 1)]]), z[lags:]


@pytest.mark.parametrize(("lags", "folds"), [(1, 5), (3, 4)])
def test_gram_matrices_are_those_of_the_rows(panel, lags, folds):
    x, f, df = panel
    pdf = MO.moments(MO.complete(df, "w", ("mkt",), scale=True), "w", lags, folds).where("w = 1").toPandas()
    m = MO.System(pdf, lags, False)
    a, y = own_rows(x, f, lags)
    labels = K.time_folds(len(y), folds)
    for k, fold in enumerate(m.folds):
        r, s = a[labels == fold], y[labels == fold]
        assert m.n[k] == len(r)
        assert np.allclose(m.xx[k], r.T @ r) and np.allclose(m.xy[k], r.T @ s) and np.allclose(m.yy[k], s.T @ s)
        assert np.allclose(m.sums()[0][k], r.sum(axis=0)) and np.allclose(m.sums()[1][k], s.sum(axis=0))
    assert m.response_std() == pytest.approx(y.std())
    b = np.random.default_rng(0).standard_normal((folds, a.shape[1], 70))
    want = [((y[labels == fold] - a[labels == fold] @ b[k]) ** 2).mean() for k, fold in enumerate(m.folds)]
    assert m.losses(b) == pytest.approx(want)


def test_nets_of_two_lags_equal_those_of_the_rows(panel, spark):
    x, f, df = panel
    points = spark.createDataFrame([(1, 0.5, 0.002)], "w int, alpha double, lambdau double")
    got = E.penalised_var(df, points, "w", factors=("mkt",), lags=2).toPandas()
    a, y = own_rows(x, f, 2)
    weights = np.ones((141, 70))
    weights[0] = 0
    b = K.elastic_net(a.T @ a, a.T @ y, len(y), 0.002 * 70, 0.5, K.rescale_weights(weights))
    std = x.std(axis=0, ddof=1)
    for lag in (1, 2):
        part = got[got["term"] == f"lag{lag}"].pivot(index="source", columns="equation", values="coef").to_numpy()
        want = b[1 + (lag - 1) * 70 : 1 + lag * 70] * std[None, :] / std[:, None]
        assert np.allclose(part, want, atol=1e-5) and 0 < (part != 0).mean() < 1
    load = got[got["term"] == "mkt"].sort_values("equation")["coef"].to_numpy()
    assert np.allclose(load, b[0] * std / f.std(ddof=1), atol=1e-5)


def test_screened_paths_are_those_of_all_regressors():
    rng = np.random.default_rng(6)
    a, y = rng.standard_normal((3, 50, 20)), rng.standard_normal((3, 50, 8))
    y += a[:, :, :8]
    grams, xys = np.swapaxes(a, 1, 2) @ a / 50, np.swapaxes(a, 1, 2) @ y / 50
    weights = rng.random((20, 8)) + 0.2
    lams = np.geomspace(3, 0.01, 12).tolist()
    for lam, b in zip(lams, K.net_path(grams, xys, lams, 0.7, weights, tol=1e-9), strict=True):
        assert np.allclose(b, K.elastic_nets(grams, xys, lam, 0.7, weights), atol=1e-6)


def test_lasso_path_and_losses(panel, spark):
    x, _, df = panel
    s = np.cov(x[:, :12], rowvar=False, ddof=0)
    falling = np.geomspace(2, 0.01, 8).tolist()
    for alpha, (cov, prec) in zip(falling, K.glasso_path(s, falling), strict=True):
        assert np.allclose(cov, K.glasso(s, alpha)[0], atol=1e-4)
        off = ~np.eye(12, dtype=bool)
        assert (np.abs(cov - s)[off] <= alpha + 1e-3).all() and np.allclose(cov @ prec, np.eye(12), atol=1e-2)
    rows = MO.on_complete_days(df.where("permno < 6 and date < 64 and w = 1"), "w")
    losses = {(r.fold, r.alpha): r.loss for r in E.lasso_losses(E.lasso_tasks(rows, "w", 5), "w", [0.05, 0.4]).collect()}
    d, labels = x[:, :6], K.shuffle_free_folds(64, 5)
    for (fold, alpha), loss in losses.items():
        rest, own = d[labels != fold], d[labels == fold]
        assert loss == pytest.approx(K.period_loss(K.glasso(np.cov(rest, rowvar=False, ddof=0), alpha)[0], own - rest.mean(axis=0)), rel=1e-4)
    assert len(losses) == 10


def test_covariances_and_the_test_of_intercepts_from_moments(panel):
    x, f, df = panel
    few = df.where("permno < 20")
    d = x[:, :20]
    matrix = lambda rows: np.array([[r.v for r in sorted(rows, key=lambda r: (r.i, r.j))]]).reshape(20, 20)
    for rule in ("soft", "lasso"):
        got = E.threshold_covariance(few.where("w = 1"), "w", 0.95, rule=rule).collect()
        assert {r.w for r in got} == {1} and np.allclose(matrix(got), K.threshold_covariance(d, 0.95, rule=rule))
    got = E.covariance(few, "w", lambda s: K.partial_correlation(np.linalg.pinv(s))).collect()
    assert {r.w for r in got} == {1}  # two dates are too few
    assert np.allclose(matrix(got), K.partial_correlation(np.linalg.pinv(np.cov(d, rowvar=False))))
    got = E.grs(few.where("date < 64"), "w", ("mkt",)).collect()
    stat, p = K.grs(d, f[:, None])
    assert [r.w for r in got] == [1] and got[0].stat == pytest.approx(stat) and got[0].p == pytest.approx(p)
    assert E.grs(df.where("date < 20"), "w", ("mkt",)).collect() == []  # more series than dates
