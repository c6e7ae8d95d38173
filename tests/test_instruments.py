import numpy as np
import pytest
from instrument_rows import k_class

from netpanel.operators import instruments as I

N, Z = 400, 35


def simulated(seed, n=N):
    """A heteroskedastic model with many weak instruments."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, Z)) + rng.standard_normal(Z)
    v = rng.standard_normal(n)
    x = z @ np.full(Z, 0.15) + v + 4
    u = 0.6 * v + rng.standard_normal(n) * (0.3 + 0.5 * np.abs(z[:, 0]))
    return 1.5 + 0.7 * x - 0.4 * z[:, 1] + u, np.column_stack([x, z[:, 1]]), z


@pytest.fixture(scope="module")
def groups(spark):
    names = ["x0", *[f"z{i}" for i in range(Z)]]
    made = {g: simulated(g) for g in (1, 2)}
    rows = [(g, t, float(y[t]), float(x[t, 0]), *map(float, z[t])) for g, (y, x, z) in made.items() for t in range(N)]
    rows += [(3, t, 1.0, float(t % 2), *[0.0] * Z) for t in range(60)]  # singular
    rows += [(4, t, 1.0, 1.0, *[1.0] * Z) for t in range(9)]  # too few
    rows += [(1, 999, None, 1.0, *[1.0] * Z), (None, 1, 1.0, 1.0, *[1.0] * Z)]
    return made, spark.createDataFrame(rows, "g long, t long, y double, " + ", ".join(f"{c} double" for c in names))


def by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, {})[r.term] = r
    return out


def run(df, method, **more):
    return by_group(I.regress(df, "y", ["x0", "z1"], [f"z{i}" for i in range(Z)], "g", method, ["t"], **more))


def with_constant(made, g):
    y, x, z = made[g]
    one = np.ones((len(y), 1))
    return y, np.hstack([one, x]), np.hstack([one, z])


def compare(got, b, se, k):
    assert [got[t].coef for t in ("const", "x0", "z1")] == pytest.approx(list(b), rel=1e-7)
    assert [got[t].se for t in ("const", "x0", "z1")] == pytest.approx(list(se), rel=1e-6)
    assert got["x0"].k == pytest.approx(k, rel=1e-8)


@pytest.mark.parametrize("method", ["2sls", "liml", "fuller"])
def test_classes_equal_the_kernel_on_the_rows(groups, method, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 64)
    made, df = groups
    got = run(df, method)
    assert set(got) == {1, 2, 3}
    assert all(got[3][t].coef is None and got[3][t].se is None for t in ("const", "x0", "z1"))
    for g in (1, 2):
        compare(got[g], *k_class(*with_constant(made, g), method))


def dense_hful(y, x, z, c=1.0):
    """The estimator's formulas with the full projector."""
    n = len(y)
    p = z @ np.linalg.inv(z.T @ z) @ z.T
    d = np.diag(p)
    xb = np.column_stack([y, x])
    least = np.linalg.eigvals(np.linalg.inv(xb.T @ xb) @ (xb.T @ p @ xb - (xb * d[:, None]).T @ xb)).real.min()
    alpha = (least - (1 - least) * c / n) / (1 - (1 - least) * c / n)
    hollow = p - np.diag(d)
    h = x.T @ hollow @ x - alpha * x.T @ x
    b = np.linalg.solve(h, x.T @ hollow @ y - alpha * x.T @ y)
    e = y - x @ b
    xh = x - np.outer(e, x.T @ e / (e @ e))
    dot = p @ xh
    s = np.zeros((x.shape[1],) * 2)
    for i in range(n):
        s += (np.outer(dot[i], dot[i]) - d[i] * np.outer(xh[i], dot[i]) - d[i] * np.outer(dot[i], xh[i])) * e[i] ** 2
    s += (xh * e[:, None]).T @ (p * p) @ (xh * e[:, None])
    inv = np.linalg.inv(h)
    return b, np.sqrt(np.diag(inv @ s @ inv)), alpha


def test_jackknife_form_equals_the_dense_formulas_with_over_thirty_instruments(groups, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 64)
    made, df = groups
    got = run(df, "hful")
    assert got[3]["x0"].coef is None and 4 not in got
    for g in (1, 2):
        compare(got[g], *dense_hful(*with_constant(made, g)))


def dense_many(y, x, z):
    b, _, k = k_class(y, x, z, "fuller")
    n, q = z.shape
    p = z @ np.linalg.inv(z.T @ z) @ z.T
    d, m, u = np.diag(p), np.eye(n) - p, y - x @ b
    alpha, sigma2 = u @ p @ u / (u @ u), u @ u / (n - x.shape[1])
    xt = x - np.outer(u, u @ x / (u @ u))
    v, f = m @ xt, p @ x
    kappa, tau = (d**2).sum() / q, q / n
    a = np.outer(((d - tau)[:, None] * f).sum(axis=0), (u[:, None] ** 2 * v).sum(axis=0) / n)
    extra = q * (kappa - tau) / (n * (1 - 2 * tau + kappa * tau)) * sum((u[t] ** 2 - sigma2) * np.outer(v[t], v[t]) for t in range(n))
    s = sigma2 * ((1 - alpha) ** 2 * xt.T @ p @ xt + alpha**2 * xt.T @ m @ xt) + a + a.T + extra
    inv = np.linalg.inv(x.T @ p @ x - alpha * x.T @ x)
    return b, np.sqrt(np.diag(inv @ s @ inv)), k


def test_many_instrument_errors_equal_the_dense_formulas(groups):
    made, df = groups
    got = run(df, "fuller", errors="many")
    for g in (1, 2):
        compare(got[g], *dense_many(*with_constant(made, g)))


def test_wrong_demands_are_refused(groups):
    _, df = groups
    for bad in ({"method": "ols"}, {"method": "2sls", "errors": "many"}, {"method": "hful", "errors": "half"}):
        with pytest.raises(ValueError):
            run(df, **bad)
    with pytest.raises(ValueError):
        I.regress(df, "y", ["x0", "z1"], ["z2"], "g")
    assert I.regress(df.limit(0), "y", ["x0"], ["z2"], "g").count() == 0
