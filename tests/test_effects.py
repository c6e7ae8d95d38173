"""Two-way effects and their kernel errors against dummies in numpy."""

import numpy as np
import pytest

from netpanel.operators import effects as FX


def panel(spark, keep, seed=0, n=12, t=15):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for s in range(t):
            for _ in range(1 + (i == 3)):  # one entity has two rows a time
                u, v = rng.standard_normal(2) + 0.3 * i + np.sin(s)
                if keep(i, s, rng.random()):
                    rows.append((i, s, float(i - 0.2 * s + u - 0.5 * v + rng.standard_normal()), float(u), float(v)))
    return rows, spark.createDataFrame(rows, "permno long, date int, y double, u double, v double")


def dummies(rows):
    a = np.array(rows)
    return np.hstack([(a[:, [0]] == np.unique(a[:, 0])).astype(float), (a[:, [1]] == np.unique(a[:, 1])).astype(float)]), a


HOLES = {
    "holes": lambda i, s, r: r < 0.6,
    "chain": lambda i, s, r: s in (i, i + 1),  # entities that overlap in one time each
    "apart": lambda i, s, r: (i < 6) == (s < 7) and r < 0.8,  # two parts that share nothing
    "whole": lambda i, s, r: True,
}


@pytest.mark.parametrize("name", sorted(HOLES))
def test_values_are_the_residuals_of_dummies(spark, name):
    rows, df = panel(spark, HOLES[name])
    d, a = dummies(rows)
    want = a[:, 2:] - d @ np.linalg.lstsq(d, a[:, 2:], rcond=None)[0]
    got = FX.two_way(df, ["y", "u", "v"], "permno", "date")
    assert got.columns == ["permno", "date", "y", "u", "v", "_y", "_u", "_v"]
    have = {(r.permno, r.date, r.y): (r._y, r._u, r._v) for r in got.collect()}
    assert len(have) == len(rows)
    assert np.allclose([have[int(r[0]), int(r[1]), r[2]] for r in a], want, atol=1e-8)


def test_fit_and_kernel_errors_equal_those_with_dummies(spark):
    rows, df = panel(spark, HOLES["holes"], seed=4)
    extra = spark.createDataFrame([(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (1, 2, None, 1.0, 1.0), (1, 2, 1.0, None, 1.0)], df.schema)
    got = {r.term: r for r in FX.two_way_fit(df.unionByName(extra), "y", ["u", "v"], lags=2).collect()}
    d, a = dummies(rows)
    res = a[:, 2:] - d @ np.linalg.lstsq(d, a[:, 2:], rcond=None)[0]
    x, y = res[:, 1:], res[:, 0]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    h = np.array([(x * (y - x @ b)[:, None])[a[:, 1] == s].sum(axis=0) for s in np.unique(a[:, 1])])
    s = h.T @ h
    for k in (1, 2):
        g = (1 - k / 3) * h[k:].T @ h[:-k]
        s += g + g.T
    back = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(back @ s @ back))
    for k, term in enumerate(("u", "v")):
        assert got[term].beta == pytest.approx(b[k]) and got[term].se == pytest.approx(se[k]) and got[term].n == len(rows)
        assert got[term].tstat == pytest.approx(b[k] / se[k])


def test_empty_panel_and_absorbed_regressors(spark):
    _, df = panel(spark, HOLES["holes"])
    assert FX.two_way_fit(df.limit(0), "y", ["u"]).collect() == []
    with pytest.raises(ValueError, match="explain"):
        FX.two_way_fit(df.withColumn("u", df["permno"] * 2.0 + df["date"]), "y", ["u"])
    with pytest.raises(ValueError, match="explain"):
        FX.two_way_fit(df.withColumn("v", df["u"] * 2.0), "y", ["u", "v"])
    with pytest.raises(RuntimeError, match="converge"):
        FX.two_way(df, ["y"], "permno", "date", steps=1)
