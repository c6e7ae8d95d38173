"""Spillover models from Spark's moments against the same model fitted from the rows."""

import math

import numpy as np
import pytest
from spillover_rows import Spillover

from netpanel.functions import kernels as K
from netpanel.operators import spillover as SP

T, N = 90, 70  # more than a block of series


@pytest.fixture(scope="module")
def data(spark):
    """(w, r, f, table, edges): window 1 whole, with one date that misses a series and one that misses the
    factor; window 2 too short; window 3 lacks a series; a series outside the network everywhere."""
    rng = np.random.default_rng(3)
    w = rng.uniform(0, 1, (N, N)) * (rng.random((N, N)) < 0.2)
    np.fill_diagonal(w, 0)
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    f = rng.standard_normal((T, 2)) + 0.3
    base = 0.1 + f @ rng.uniform(0.5, 1.5, (2, N)) + rng.standard_normal((T, N)) * rng.uniform(0.5, 1.5, N)
    r = base @ np.linalg.inv(np.eye(N) - 0.5 * w).T
    cells = [(1, t, k, float(r[t, k]), float(f[t, 0]), float(f[t, 1])) for t in range(T) for k in range(N)]
    cells += [(1, t, 999, 1.0, float(f[t, 0]), float(f[t, 1])) for t in range(0, T, 2)]
    cells += [(1, T, k, 1.0, 0.0, 0.0) for k in range(N - 1)] + [(1, T + 1, k, 1.0, None, 0.0) for k in range(N)]
    cells += [(2, t, k, float(r[t, k]), 1.0, 1.0) for t in range(4) for k in range(N)]
    cells += [(3, t, k, float(r[t, k]), float(f[t, 0]), float(f[t, 1])) for t in range(20) for k in range(N - 1)]
    table = spark.createDataFrame(cells, "w int, date int, permno long, x double, mkt double, smb double").repartition(5)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(N) for j in range(N)], "i long, j long, v double")
    return w, r, f, table, edges


def in_window(data, fit, schema):
    _, _, _, table, edges = data
    return SP.fitted(table, edges, "w", fit, schema, ("mkt", "smb")).collect()


def moments_of(w, r, f, **free):
    rc, fc = r - r.mean(axis=0), f - f.mean(axis=0)
    return SP.Model(SP.Network(np.arange(len(w)), w), len(r), r.mean(axis=0), f.mean(axis=0), rc.T @ rc, fc.T @ rc, fc.T @ fc, **free)


@pytest.mark.parametrize("method", ["ols", "wls", "mle"])
def test_fits_in_spark_equal_those_of_the_rows(data, method):
    import pandas as pd

    def fit(model):
        m = getattr(model(), f"fit_{method}")()
        return pd.DataFrame({"permno": m.net.labels, "c": m.c, "alpha": m.alpha, "b0": m.beta[:, 0], "b1": m.beta[:, 1], "ll": m.log_likelihood(m.c), "aic": m.aic(), "lr": m.likelihood_ratio()[0]})

    got = sorted(in_window(data, fit, "permno long, c double, alpha double, b0 double, b1 double, ll double, aic double, lr double"), key=lambda r: r.permno)
    assert [r.w for r in got] == [1] * N and [r.permno for r in got] == list(range(N))
    want = getattr(Spillover(*data[:3]), f"fit_{method}")()
    assert got[0].c == pytest.approx(want.c, abs=1e-5)
    assert np.allclose([r.alpha for r in got], want.alpha, atol=1e-4)
    assert np.allclose([[r.b0, r.b1] for r in got], want.beta, atol=1e-4)
    assert got[0].ll == pytest.approx(want.log_likelihood(want.c), abs=1e-4) and got[0].aic == pytest.approx(want.aic(), abs=1e-3)
    assert got[0].lr == pytest.approx(want.likelihood_ratio()[0], rel=1e-5)


def test_shares_premia_and_tests_equal_those_of_the_rows(data):
    w, r, f = data[:3]
    old, new = Spillover(w, r, f).fit_mle(), moments_of(w, r, f).fit_mle()
    assert new.partial_r2() == pytest.approx(old.partial_r2(), abs=1e-5)
    even = np.full(N, 1 / N)
    for name, value in old.premia(even).items():
        assert np.allclose(new.premia(even)[name], value, atol=1e-5), name
    for name, value in old.variance_parts().items():
        assert np.allclose(new.variance_parts()[name], value, atol=1e-5), name
    assert new.standard_errors()[0] == pytest.approx(old.standard_error(), rel=1e-3)
    assert new.wald()[0] == pytest.approx(old.wald()[0], rel=1e-3)
    assert abs(new.score(new.c)) < 1e-4


def full_likelihood(theta, w, r, f, free):
    n, k = len(w), f.shape[1]
    a = theta[:n] if free.get("intercepts", True) else np.zeros(n)
    b = theta[n : n + n * k].reshape(n, k) if free.get("loadings", True) else np.zeros((n, k))
    d = np.eye(n) - theta[-1] * w
    e = r @ d.T - a - f @ b.T
    return len(r) * np.linalg.slogdet(d)[1] - len(r) / 2 * np.log((e**2).mean(axis=0)).sum() - r.size / 2 * (math.log(2 * math.pi) + 1)


def small(seed=5, n=4, t=80):
    rng = np.random.default_rng(seed)
    w = rng.uniform(0, 1, (n, n))
    np.fill_diagonal(w, 0)
    w /= w.sum(axis=1, keepdims=True)
    f = rng.standard_normal((t, 2)) + 0.5
    r = (0.2 + f @ rng.uniform(0.5, 1.5, (2, n)) + rng.standard_normal((t, n))) @ np.linalg.inv(np.eye(n) - 0.4 * w).T
    return w, r, f


@pytest.mark.parametrize("free", [{}, {"intercepts": False}, {"loadings": False}, {"intercepts": False, "loadings": False}])
def test_errors_are_the_curvature_of_the_whole_likelihood(free):
    w, r, f = small()
    m = moments_of(w, r, f, **free).fit_mle()
    theta = np.concatenate([m.alpha, m.beta.ravel(), [m.c]])
    use = np.concatenate([np.full(4, free.get("intercepts", True)), np.full(8, free.get("loadings", True)), [True]])
    assert m.log_likelihood(m.c) == pytest.approx(full_likelihood(theta, w, r, f, free), abs=1e-8)
    at, h = np.flatnonzero(use), 1e-4
    hess = np.zeros((len(at), len(at)))
    for i, p in enumerate(at):
        step = np.zeros(len(theta))
        step[p] = h
        assert abs(full_likelihood(theta + step, w, r, f, free) - full_likelihood(theta - step, w, r, f, free)) / (2 * h) < 1e-3
        for j, q in enumerate(at):
            other = np.zeros(len(theta))
            other[q] = h
            hess[i, j] = sum(s * u * full_likelihood(theta + s * step + u * other, w, r, f, free) for s in (1, -1) for u in (1, -1)) / (4 * h * h)
    want = np.full(len(theta), np.nan)
    want[at] = np.sqrt(np.diag(np.linalg.inv(-hess)))
    c, alpha, beta = m.standard_errors()
    assert np.allclose(np.concatenate([alpha, beta.ravel(), [c]]), want, rtol=1e-3, equal_nan=True)


def test_pooled_errors_are_those_of_the_stacked_regression():
    w, r, f = small(t=30)
    m = moments_of(w, r, f).fit_ols()
    t, n = r.shape
    x = np.zeros((t * n, 3 * n + 1))
    for i in range(n):
        x[i * t : (i + 1) * t, 3 * i : 3 * i + 3] = np.column_stack([np.ones(t), f])
        x[i * t : (i + 1) * t, -1] = r @ w[i]
    y = r.T.ravel()
    b = K.ols(x, y)
    se = np.sqrt(((y - x @ b) ** 2).sum() / (t * n - 3 * n - 1) * np.diag(np.linalg.inv(x.T @ x)))
    c, alpha, beta = m.pooled_errors()
    assert m.c == pytest.approx(b[-1]) and c == pytest.approx(se[-1])
    assert np.allclose(np.column_stack([alpha, beta]).ravel(), se[:-1]) and np.allclose(np.column_stack([m.alpha, m.beta]).ravel(), b[:-1])


def test_restricted_searches():
    w, r, f = small()
    whole = moments_of(w, r, f).fit_mle()
    assert moments_of(w, r, f).fit_mle(spillovers=False).c == 0
    free = moments_of(w, r, f).fit_mle(unconstrained=True)
    assert free.log_likelihood(free.c, any_sign=True) >= whole.log_likelihood(whole.c) - 1e-9
    tried = [moments_of(w, r, f).log_likelihood(c, any_sign=True) for c in np.linspace(-9.9, 9.9, 4001)]
    assert free.log_likelihood(free.c, any_sign=True) >= max(tried) - 1e-9
    bare = moments_of(w, r, f, intercepts=False, loadings=False).fit_mle()
    assert bare.log_likelihood(bare.c) < whole.log_likelihood(whole.c) and not bare.alpha.any() and not bare.beta.any()


def test_no_network_and_no_rows(spark, data):
    import pandas as pd

    _, _, _, table, edges = data
    fit = lambda model: pd.DataFrame({"c": [model().fit_ols().c]})
    assert SP.fitted(table, edges.limit(0), "w", fit, "c double", ("mkt", "smb")).collect() == []
    assert SP.fitted(table.limit(0), edges, "w", fit, "c double", ("mkt", "smb")).collect() == []
