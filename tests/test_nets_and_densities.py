"""Sign nets against the stacked regression, density curves against the exact kernel estimate."""

import math

import numpy as np
import pytest

from netpanel.functions import kernels as K
from netpanel.operators import correlation_net as CN
from netpanel.operators import density as DN


def test_sign_nets_are_those_of_the_stacked_regression(spark):
    rng = np.random.default_rng(2)
    t, n, folds = 26, 4, 5
    x = rng.standard_normal((t, n)) + rng.standard_normal((t, 1))
    df = spark.createDataFrame([(1, s, i, float(x[s, i])) for s in range(t) for i in range(n)] + [(1, t, 0, 1.0)] + [(2, s, 0, 1.0) for s in range(t)] + [(3, 0, 0, 1.0)], "w int, date int, permno long, x double")
    z = x - x.mean(axis=0)
    y = np.sign(z[:, :, None] * z[:, None, :]).reshape(t, n * n)
    labels = K.shuffle_free_folds(t, folds)

    def stacked(rows, alpha, lam):  # coordinate descent on the whole design
        size = len(rows) * n * n
        a = np.kron(np.eye(n * n), np.ones((len(rows), 1)))
        return K.elastic_net(a.T @ a, (a.T @ rows.T.reshape(-1, 1)), size, lam, alpha, np.ones((n * n, 1)))[:, 0]

    points = [(0.5, 0.001), (0.5, 0.02), (1.0, 0.01), (0.25, 0.05)]
    sums = CN.sign_sums(df, "w", folds, 2 * folds)
    found = {(r.alpha, r.lambdau): r.loss for r in CN.losses(sums.where("w = 1"), "w", points).collect()}
    for a, lam in points:
        want = np.mean([((y[labels == f] - stacked(y[labels != f], a, lam)) ** 2).mean() for f in range(folds)])
        assert found[a, lam] == pytest.approx(want, abs=1e-7)
    top = min(points, key=lambda p: found[p])
    got = CN.search(df, "w", points, folds).collect()
    assert {r.w for r in got} == {1, 2}  # one date is too few
    b = stacked(y, *top).reshape(n, n)
    for r in got:
        if r.w == 1:
            assert (r.alpha, r.lambdau) == top and r.v == pytest.approx(b[r.i, r.j], abs=1e-7)
        else:
            assert r.v == 0  # a constant series has no signs
    assert CN.search(df.limit(0), "w", points, folds).collect() == []


def test_density_curves(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal(3000), 4 + 0.5 * rng.standard_normal(1000)])
    rows = [("a", float(e)) for e in v] + [("one", 1.0), ("same", 2.0), ("same", 2.0), ("a", None), (None, 1.0), ("a", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = sorted(DN.density(df, "v", ["g"], points=80).collect(), key=lambda r: r.point)
    assert {r.g for r in got} == {"a"} and [r.point for r in got] == list(range(80))
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.array([r.x for r in got])
    assert np.allclose(x, np.linspace(v.min() - 0.05 * np.ptp(v), v.max() + 0.05 * np.ptp(v), 80))
    exact = np.exp(-(((x[:, None] - v[None, :]) / h) ** 2) / 2).mean(axis=1) / h / math.sqrt(2 * math.pi)
    assert np.abs(np.array([r.density for r in got]) - exact).max() < 1e-4 * exact.max()
    assert np.allclose([r.scaled for r in got], [r.density * np.ptp(v) / 80 * len(v) for r in got])
    kept = v[(v > np.quantile(v, 0.05)) & (v < np.quantile(v, 0.95))]
    cut = DN.density(df, "v", ["g"], points=50, tails=0.1).collect()
    assert min(r.x for r in cut) == pytest.approx(kept.min() - 0.05 * np.ptp(kept))
    assert DN.density(df.limit(0), "v", ["g"]).collect() == []
