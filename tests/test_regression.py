import numpy as np
import pytest

from netpanel.operators import models as E
from netpanel.operators import regression as R


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, float(rng.standard_normal() + i + 0.1 * t)) for i in range(12) for t in range(20)]
    rows = [(i, t, x, float(2 * x + 3 * i - t + rng.standard_normal())) for i, t, x in rows]
    return rows, spark.createDataFrame(rows, "permno long, date long, x double, y double")


@pytest.mark.parametrize("effects", ["none", "entity", "time", "both"])
def test_fixed_effects_equal_dummies(panel, effects):
    rows, df = panel
    a = np.array(rows)
    cols = [a[:, 2], np.ones(len(a))]
    if effects in ("entity", "both"):
        cols += [a[:, 0] == k for k in range(1, 12)]
    if effects in ("time", "both"):
        cols += [a[:, 1] == k for k in range(1, 20)]
    want = np.linalg.lstsq(np.column_stack(cols).astype(float), a[:, 3], rcond=None)[0][0]
    got = R.panel_ols(df, "y", "x", effects).first()
    assert got.beta == pytest.approx(want) and got.n == len(rows)


def test_grouped_ols_equals_lstsq_and_skips_singular_groups(panel, spark):
    rows, df = panel
    df = df.selectExpr("*", "x * x as x2", "1.0 as flat")
    got = {r.permno: r for r in R.ols(df, "y", ["x", "x2"], ["permno"]).collect()}
    for k in range(12):
        a = np.array([r for r in rows if r[0] == k])
        d = np.column_stack([np.ones(20), a[:, 2], a[:, 2] ** 2])
        b = np.linalg.lstsq(d, a[:, 3], rcond=None)[0]
        e = a[:, 3] - d @ b
        assert [got[k].const, got[k].b_x, got[k].b_x2] == pytest.approx(b.tolist())
        assert got[k].sigma2 == pytest.approx(e @ e / 17)
    assert R.ols(df, "y", ["flat"], ["permno"]).where("b_flat is not null").count() == 0
    with pytest.raises(ValueError):
        R.panel_ols(df, "y", "x", "half")


def test_penalised_path_prefers_no_penalty_where_the_signal_is_strong(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((240, 2))
    for t in range(1, 240):
        x[t] = np.array([[0.8, 0.1], [0.0, 0.7]]) @ x[t - 1] + 0.3 * rng.standard_normal(2)
    df = spark.createDataFrame([(1, t, k, float(x[t, k])) for t in range(240) for k in range(2)], "w int, date int, permno long, x double")
    scores = E.penalised_path(df, R.grid(spark, {"alpha": [1.0], "lambdau": [0.001, 0.9]}), "w", folds=4)
    assert scores.count() == 8
    best = E.best_point(scores, "w").first()
    assert best.lambdau == 0.001
    coefs = E.penalised_var(df, E.best_point(scores, "w"), "w")
    own = {(r.equation, r.source): r.coef for r in coefs.where("term = 'lag1'").collect()}
    assert own[0, 0] == pytest.approx(0.8, abs=0.12) and own[1, 1] == pytest.approx(0.7, abs=0.15)
    res = E.residual_rows(df, coefs, "w")
    assert res.count() == 239 * 2
    got = {(r.date, r.permno): r.fitted for r in res.collect()}
    const = {r.equation: r.coef for r in coefs.where("term = 'const'").collect()}
    assert got[100, 0] == pytest.approx(const[0] + own[0, 0] * x[99, 0] + own[0, 1] * x[99, 1])


def test_first_stage_and_nets_search_the_whole_grid(spark):
    from netpanel.functions import kernels as K
    from netpanel.plans import models as Q

    rng = np.random.default_rng(8)
    x = rng.standard_normal((61, 3))
    x[1:] += 0.6 * x[:-1]
    df = spark.createDataFrame([(1, t, k, float(x[t, k]), float(x[t].mean())) for t in range(61) for k in range(3)], "w int, date int, permno long, x double, mkt double")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y, lag = z[1:], z[:-1]
    points = np.unique(np.r_[np.geomspace(y.std() / 9, y.std() * 9, 25), np.linspace(y.std() / 9, y.std() * 9, 25)])
    labels, scores = K.time_folds(60, 12), []
    for lam in points:  # ridge on the stacked problem I x lag
        total = 0.0
        for k in range(12):
            a, b = np.kron(np.eye(3), lag[labels != k]), y[labels != k].T.ravel()
            beta = np.linalg.solve(a.T @ a / len(b) + lam * np.eye(9), a.T @ b / len(b))
            total += ((np.kron(np.eye(3), lag[labels == k]) @ beta - y[labels == k].T.ravel()) ** 2).mean()
        scores.append(total)
    assert E.first_points(df, "w").first().ini == pytest.approx(points[int(np.argmin(scores))])
    assert [len(v) for v in Q.VAR_GRID.values()] == [13, 13] and len(Q.COV_GRID) == len(Q.SIGMA_GRID) == 50
    # factors are free: a penalty that takes every lag leaves the loading
    _, d, r = E.net_inputs(df.toPandas(), ("mkt",))
    b = E.net(d, r, 50.0, 1.0, E.mask(d, r, False))
    assert np.abs(b[0]).min() > 0.1 and np.allclose(b[1:], 0)
    w = rng.random((4, 3))
    each = [K.elastic_net(d[i:].T @ d[i:], d[i:].T @ r[i:], 60 - i, 0.05, 0.5, w) for i in (0, 7)]
    both = K.elastic_nets(np.stack([d[i:].T @ d[i:] / (60 - i) for i in (0, 7)]), np.stack([d[i:].T @ r[i:] / (60 - i) for i in (0, 7)]), 0.05, 0.5, w)
    assert np.allclose(both, each, atol=1e-5)
    out = E.estimate_fevd(df, R.grid(spark, {"alpha": [0.1, 1.0], "lambdau": [0.01, 0.1]}), "w", [0.01, 0.1], ("mkt",)).toPandas()
    assert len(out) == 9 and out.groupby("i")["v"].sum().to_numpy() == pytest.approx(np.ones(3))


@pytest.mark.parametrize("effects", ["none", "entity", "time"])
def test_kernel_errors_equal_those_of_the_rows(panel, effects):
    rows, df = panel
    a = np.array([r for r in rows if (r[0] * 7 + r[1]) % 5])  # a panel with holes
    x, y = a[:, 2].copy(), a[:, 3].copy()
    group = {"none": np.zeros(len(a)), "entity": a[:, 0], "time": a[:, 1]}[effects]
    for g in np.unique(group):
        x[group == g] -= x[group == g].mean()
        y[group == g] -= y[group == g].mean()
    beta = x @ y / (x @ x)
    h = np.array([(x * (y - beta * x))[a[:, 1] == t].sum() for t in range(20)])
    s = h @ h + sum(2 * (1 - k / 4) * (h[k:] @ h[:-k]) for k in (1, 2, 3))
    got = R.panel_errors(df.where("(permno * 7 + date) % 5 <> 0"), "y", "x", effects).first()
    assert got.beta == pytest.approx(beta) and got.se == pytest.approx(np.sqrt(s) / (x @ x)) and got.n == len(a)
