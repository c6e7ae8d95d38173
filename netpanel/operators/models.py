"""Estimation by window: every function deals the windows of a long panel (key, date, permno, x)
to tasks and returns long tables. Missing cells drop the date; a window that is too short for
its model gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import moments as MO
from .matrices import edge_rows


def wide(pdf: pd.DataFrame, value: str = "x") -> pd.DataFrame:
    """date x permno without the dates that miss a value."""
    return pdf.pivot(index="date", columns="permno", values=value).sort_index().dropna()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in a fixed number of partitions by window (and part of its work): adaptive execution would put
    the few rows of all windows into one task, however long a window's search takes."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32), *keys)


def windows(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, least: int = 8) -> DataFrame:
    """fn(pdf of one window) with the key put in front."""
    kind = dict(df.dtypes)[key]
    empty = pd.DataFrame({c.split()[0]: [] for c in f"{key} {kind}, {schema}".split(", ")}, dtype=object)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["date"].nunique() < least:
            return empty
        out = fn(pdf)
        if out is None:
            return empty
        if key in out:
            out = out.drop(columns=key)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def factor_of(pdf: pd.DataFrame, dates: pd.Index, names: Iterable[str]) -> np.ndarray:
    return pdf.drop_duplicates("date").set_index("date").loc[dates, list(names)].to_numpy(float)


# --- vector autoregressions ----------------------------------------------------------------


#: Dates that a window needs to be estimated at all.
LEAST = 8


def var_ols(df: DataFrame, key: str, lags: int = 1, factors: tuple[str, ...] = ()) -> DataFrame:
    """key, equation, term (const, factor name or lag), source, coef."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, lags, True)
        if m.n.sum() + lags < LEAST or m.n.sum() <= len(m.xx[0]):
            return None
        return coef_rows(m.own_units(m.least_squares(), False), m.names, factors, lags)

    return MO.solved(MO.moments(MO.complete(df, key, factors), key, lags), key, fit, "equation long, term string, source long, coef double")


def var_covariance(df: DataFrame, key: str, lags: int = 1, factors: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """key, i, j, v: sample covariance of the least-squares residuals, from the same moments."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, lags, True)
        if m.n.sum() + lags < least or m.n.sum() <= len(m.xx[0]):
            return None
        return edge_rows(m.names, residual_squares(m, m.least_squares()) / (m.n.sum() - 1))

    return MO.solved(MO.moments(MO.complete(df, key, factors), key, lags), key, fit, "i long, j long, v double")


def residual_squares(m: MO.System, b: np.ndarray) -> np.ndarray:
    """Sums of products of the residuals under coefficients b."""
    xx, xy, yy, _ = m.total()
    return yy - b.T @ xy - xy.T @ b + b.T @ xx @ b


def coef_rows(b: np.ndarray, names: pd.Index, factors: tuple[str, ...], lags: int) -> pd.DataFrame:
    terms = ["const", *factors, *[f"lag{k}" for k in range(1, lags + 1) for _ in names]]
    sources = [-1] * (1 + len(factors)) + list(names) * lags
    n = len(names)
    return pd.DataFrame({"equation": np.tile(names, len(terms)), "term": np.repeat(terms, n), "source": np.repeat(sources, n), "coef": b.ravel()})


def standardised(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, std = w.mean(axis=0), w.std(axis=0, ddof=1)
    return (w - mean) / np.where(std > 0, std, 1), mean, std


def unscale(b: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (sources x equations) of standardised data in the data's own units, and intercepts."""
    own = b * std[None, :] / std[:, None]
    return mean - mean @ own, own


def net_inputs(pdf: pd.DataFrame, factors: tuple[str, ...]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(wide panel, x, y) on standardised data: x has the factors of the day, then the lagged series."""
    w = wide(pdf)
    z, _, _ = standardised(w.to_numpy())
    f = [standardised(factor_of(pdf, w.index, factors))[0][1:]] if factors else []
    return w, np.hstack([*f, z[:-1]]), z[1:]


def net(x: np.ndarray, y: np.ndarray, lam: float, alpha: float, weights: np.ndarray) -> np.ndarray:
    """Coefficients of the stacked problem: its loss is the mean over rows and equations, so that
    a penalty counts once for each equation against the mean over rows alone."""
    return K.elastic_net(x.T @ x, x.T @ y, len(y), lam * y.shape[1], alpha, weights)


def net_moments(df: DataFrame, key: str, folds: int = 12, factors: tuple[str, ...] = (), lags: int = 1) -> DataFrame:
    """Moments of standardised data by window and fold, which searches and fits share: they are kept (a few
    matrices a window), and Spark makes lost ones again. A table that holds them already stays as it is."""
    return df if "kind" in df.columns else MO.moments(MO.complete(df, key, factors, scale=True), key, lags, folds).persist()


def net_system(pdf: pd.DataFrame, folds: int) -> MO.System | None:
    """A window's moments without a constant (the number of lags is the largest that its rows have);
    None if it is too short for its folds."""
    lags = int(pdf.loc[pdf["kind"] == "c", "lag"].max())
    m = MO.System(pdf, lags, False)
    return m if len(m.folds) == folds and m.n.sum() + lags >= 2 * folds else None


def fold_scores(m: MO.System, path: Iterable[float], alpha: float, weights: np.ndarray) -> list[tuple[float, list[float]]]:
    """(penalty, out-of-fold mean squared errors) along a path of penalties, which fall from fit to
    fit. The loss is the mean over rows and equations, so that a penalty counts once for
    each equation against the mean over rows alone."""
    lams = sorted(path, reverse=True)
    grams, xys = m.rest()
    fits = K.net_path(grams, xys, [lam * xys.shape[2] for lam in lams], alpha, weights)
    return [(float(lam), m.losses(b)) for lam, b in zip(lams, fits, strict=True)]


def penalised_path(df: DataFrame, grid: DataFrame, key: str, folds: int = 12, first: DataFrame | None = None, gamma: float = 1.0, free_diagonal: bool = False, factors: tuple[str, ...] = (), lags: int = 1) -> DataFrame:
    """key, alpha, lambdau, fold, mse: out-of-fold errors of each grid point on standardised data (a panel,
    or its net_moments()).

    Windows and values of alpha are dealt out as groups of their own, each with the moments of all
    folds and a whole path of penalties. With ``first`` (first_points()) the net is adaptive: its weights
    come from that first fit on the whole window. Factors are not penalised."""
    found = net_moments(df, key, folds, factors, lags)
    if first is not None:
        found = found.join(F.broadcast(first), key)
    tasks = found.crossJoin(F.broadcast(grid.groupBy("alpha").agg(F.collect_set("lambdau").alias("path"))))

    def score(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = net_system(pdf, folds)
        if m is None:
            return None
        weights = weights_of(m, pdf, gamma, free_diagonal)
        scores = fold_scores(m, pdf["path"].iloc[0], float(pdf["alpha"].iloc[0]), weights)
        return pd.DataFrame([(lam, k, e) for lam, errors in scores for k, e in zip(m.folds, errors, strict=True)], columns=["lambdau", "fold", "mse"])

    return MO.solved(dealt(tasks, key, "alpha"), key, score, "lambdau double, fold int, mse double", by=("alpha",))


def weights_of(m: MO.System, pdf: pd.DataFrame, gamma: float, free_diagonal: bool) -> np.ndarray:
    """Penalty weights of a window: adaptive ones if its rows name a first-stage penalty ``ini``."""
    plain = penalty_weights(m, free_diagonal)
    if "ini" not in pdf:
        return plain
    xx, xy, _, n = m.total()
    ridge = K.elastic_net(xx, xy, n, float(pdf["ini"].iloc[0]) * xy.shape[1], 0.0, plain)
    return K.rescale_weights(K.adaptive_weights(ridge, n * xy.shape[1], gamma, plain))


def penalty_weights(m: MO.System, free_diagonal: bool) -> np.ndarray:
    """Weights 1, but 0 for factors and, if free, own lags of every order."""
    k, n = len(m.factors), len(m.names)
    w = np.ones((k + m.lags * n, n))
    w[:k] = 0
    if free_diagonal:
        for a in range(m.lags):
            np.fill_diagonal(w[k + a * n : k + (a + 1) * n], 0)
    return K.rescale_weights(w)


def mask(x: np.ndarray, y: np.ndarray, free_diagonal: bool) -> np.ndarray:
    """Weights 1, but 0 for factors (the columns of x before the series) and, if free, own lags."""
    k = x.shape[1] - y.shape[1]
    w = np.ones((x.shape[1], y.shape[1]))
    w[:k] = 0
    if free_diagonal:
        np.fill_diagonal(w[k:], 0)
    return K.rescale_weights(w)


#: Points of each scale of the first stage's grid, and the groups that they are dealt out in.
FIRST_POINTS, FIRST_PARTS = 25, 5


def guessed_grid(m: MO.System) -> np.ndarray:
    """First-stage penalties: a geometric and a linear scale from std(y) / k to std(y) * k, k the
    coefficients of all equations."""
    k, std = m.xy[0].size, m.response_std()
    return np.unique(np.concatenate([np.geomspace(std / k, std * k, FIRST_POINTS), np.linspace(std / k, std * k, FIRST_POINTS)]))


def first_points(df: DataFrame, key: str, folds: int = 12, free_diagonal: bool = False, factors: tuple[str, ...] = (), lags: int = 1) -> DataFrame:
    """key, ini: each window's first-stage (ridge) penalty, the point of its guessed grid of least
    out-of-fold error. Windows and parts of the grid are dealt out as groups."""
    at = df.sparkSession.range(FIRST_PARTS).select(F.col("id").cast("int").alias("at"))
    found = net_moments(df, key, folds, factors, lags).crossJoin(F.broadcast(at))

    def score(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = net_system(pdf, folds)
        if m is None:
            return None
        scores = fold_scores(m, guessed_grid(m)[int(pdf["at"].iloc[0]) :: FIRST_PARTS], 0.0, penalty_weights(m, free_diagonal))
        return pd.DataFrame([(lam, float(np.mean(errors))) for lam, errors in scores], columns=["ini", "mse"])

    scores = MO.solved(dealt(found, key, "at"), key, score, "ini double, mse double", by=("at",))
    return scores.groupBy(key).agg(F.min(F.struct("mse", "ini")).alias("b")).select(key, F.col("b.ini").alias("ini")).persist()


def best_point(scores: DataFrame, key: str) -> DataFrame:
    """key, alpha, lambdau, mse: the grid point of least mean error (ties: least alpha, then lambdau)."""
    mean = scores.groupBy(key, "alpha", "lambdau").agg(F.avg("mse").alias("mse"))
    best = F.min(F.struct("mse", "alpha", "lambdau")).alias("b")
    return mean.groupBy(key).agg(best).select(key, "b.alpha", "b.lambdau", "b.mse")


def fitted_net(m: MO.System, pdf: pd.DataFrame, gamma: float, free_diagonal: bool) -> np.ndarray:
    """Coefficients of standardised data at the window's point (columns alpha, lambdau and, if adaptive, ini)."""
    xx, xy, _, n = m.total()
    lam = float(pdf["lambdau"].iloc[0]) * xy.shape[1]
    return K.net_path(xx[None] / n, xy[None] / n, [lam], float(pdf["alpha"].iloc[0]), weights_of(m, pdf, gamma, free_diagonal), tol=1e-8)[0][0]


def penalised_var(df: DataFrame, points: DataFrame, key: str, first: DataFrame | None = None, gamma: float = 1.0, free_diagonal: bool = False, factors: tuple[str, ...] = (), lags: int = 1) -> DataFrame:
    """Coefficients, in the data's units, at each window's point (key, alpha, lambdau)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, int(pdf.loc[pdf["kind"] == "c", "lag"].max()), False)
        if m.n.sum() + m.lags < LEAST:
            return None
        return coef_rows(m.own_units(fitted_net(m, pdf, gamma, free_diagonal), True), m.names, factors, m.lags)

    found = net_moments(df, key, 1, factors, lags)
    return MO.solved(at_points(found, points, key, first), key, fit, "equation long, term string, source long, coef double")


def adaptive_weights(df: DataFrame, first: DataFrame, key: str, gamma: float = 1.0) -> DataFrame:
    """key, equation, source, weight of the adaptive net's first lag."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, 1, False)
        w = weights_of(m, pdf, gamma, False)
        return edge_rows(m.names, w).rename(columns={"i": "source", "j": "equation", "v": "weight"})[["equation", "source", "weight"]]

    return MO.solved(net_moments(df, key, 1).join(F.broadcast(first), key), key, fit, "equation long, source long, weight double")


def at_points(df: DataFrame, points: DataFrame, key: str, first: DataFrame | None) -> DataFrame:
    out = df.join(F.broadcast(points.select(key, "alpha", "lambdau")), key)
    return out if first is None else out.join(F.broadcast(first), key)


def residual_rows(df: DataFrame, coefs: DataFrame, key: str) -> DataFrame:
    """key, date, permno, fitted, resid of a first-order model: coefficients joined to the lagged
    panel as an edge list, and summed."""
    w = Window.partitionBy(key, "permno").orderBy("date")
    now = df.select(key, F.col("permno").alias("equation"), "date", F.col("x").alias("actual"))
    lag = df.select(key, F.col("permno").alias("source"), F.lead("date").over(w).alias("date"), "x").where("date is not null")
    part = lag.join(coefs.where("term = 'lag1'"), [key, "source"]).groupBy(key, "equation", "date").agg(F.sum(F.col("coef") * F.col("x")).alias("s"))
    const = coefs.where("term = 'const'").select(key, "equation", F.col("coef").alias("c"))
    joined = now.join(part, [key, "equation", "date"]).join(const, [key, "equation"])
    return joined.select(key, "date", F.col("equation").alias("permno"), "actual", (F.col("s") + F.col("c")).alias("fitted"), (F.col("actual") - F.col("s") - F.col("c")).alias("resid"))


# --- covariance and decomposition -----------------------------------------------------------


#: Added to the id of a series for that of its squares.
SQUARES = 1 << 40


def second_moments(rows: DataFrame, key: str, fn: Callable[[MO.System], pd.DataFrame | None], schema: str) -> DataFrame:
    """fn of each window's moments without lags, of rows (key, pos, dates, permno, x); under LEAST dates give no row."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, 0, True)
        return fn(m) if m.n.sum() >= LEAST else None

    return MO.solved(MO.moments(MO.centred(rows, key), key, 0), key, fit, schema)


def covariance(df: DataFrame, key: str, method: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, i, j, v: method of each window's sample covariance, from moments."""
    out = lambda m: edge_rows(m.names, method(m.total()[2] / (m.n.sum() - 1)))
    return second_moments(MO.on_complete_days(df, key), key, out, "i long, j long, v double")


def threshold_covariance(df: DataFrame, key: str, delta: float, eta: float = 4.0, rule: str = "lasso") -> DataFrame:
    """key, i, j, v: each window's covariance under adaptive thresholds. The spread of a pair's products comes
    from the moments of the squares, which stand beside the series under ids of their own."""
    rows = MO.on_complete_days(df, key)
    own = rows.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(key, "permno")))
    squares = own.withColumn("permno", F.col("permno") + SQUARES).withColumn("x", F.col("x") * F.col("x"))

    def fit(m: MO.System) -> pd.DataFrame:
        t, n = float(m.n.sum()), len(m.names) // 2
        products, both = m.total()[2][:n, :n], m.total()[2][n:, n:] / t + np.outer(m.mean[n:], m.mean[n:])
        cov = products / (t - 1)
        theta = np.maximum(both - 2 * cov * products / t + cov**2, 0)
        return edge_rows(m.names[:n], K.thresholded(cov, theta, t, delta, eta, rule))

    return second_moments(own.unionByName(squares), key, fit, "i long, j long, v double")


def grs(df: DataFrame, key: str, factors: tuple[str, ...]) -> DataFrame:
    """key, stat, p: the test that all intercepts of the series on the factors are zero, from moments; a
    window without more dates than series and factors gives no row."""

    def fit(m: MO.System) -> pd.DataFrame | None:
        t, k = float(m.n.sum()), len(m.factors)
        if t <= len(m.names) + k + 1:
            return None
        b = m.least_squares()
        ee = residual_squares(m, b)
        return pd.DataFrame([K.grs_of(t, m.own_units(b, False)[0], ee, m.factor_mean, m.total()[0][1:, 1:] / t)], columns=["stat", "p"])

    return second_moments(MO.on_complete_days(df.dropna(subset=list(factors)), key, factors), key, fit, "stat double, p double")


def lasso_tasks(rows: DataFrame, key: str, folds: int = 12) -> DataFrame:
    """key, fold, n, names, s, p, q of rows (key, pos, dates, permno, x): for each fold the covariance s of the
    other dates, and about their means the fold's sums p of products and q of squared products; fold -1
    has the covariance of all dates. Squares of the series stand beside them, so that all of it
    comes from one table of moments."""
    each = Window.partitionBy(key, "permno")
    level = rows.select(key, "pos", "dates", "permno", (F.col("x") - F.avg("x").over(each)).alias("x")).persist()
    both = level.unionByName(level.select(key, "pos", "dates", (F.col("permno") + SQUARES).alias("permno"), (F.col("x") * F.col("x")).alias("x")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, 0, True)
        k = int((m.names < SQUARES).sum())
        if len(m.folds) < 2 or k < 2:
            return None
        mean = m.mean[k:]  # of the squares; the series themselves have mean 0
        ones = np.stack([np.concatenate([x[0], xy[0]]) for x, xy in zip(m.xx, m.xy, strict=True)])[:, 1:]
        sums, second, third, fourth = ones[:, :k], m.yy[:, :k, :k], m.yy[:, k:, :k], m.yy[:, k:, k:]
        n = m.n[:, None, None]
        squares = ones[:, k:] + m.n[:, None] * mean  # sums of x_i ** 2
        third = third + mean[None, :, None] * sums[:, None, :]  # of x_i ** 2 x_j
        fourth = fourth + mean[None, :, None] * ones[:, None, k:] + mean[None, None, :] * ones[:, k:, None] + n * np.multiply.outer(mean, mean)
        out = []
        for f, fold in enumerate(m.folds):
            rest = m.n.sum() - m.n[f]
            mu = (sums.sum(axis=0) - sums[f]) / rest
            s = (second.sum(axis=0) - second[f]) / rest - np.outer(mu, mu)
            p = second[f] - np.outer(sums[f], mu) - np.outer(mu, sums[f]) + m.n[f] * np.outer(mu, mu)
            # (x_i^2 - 2 mu_i x_i + mu_i^2) (x_j^2 - 2 mu_j x_j + mu_j^2), summed
            left = third[f] * (-2 * mu)[None, :] + squares[f][:, None] * (mu**2)[None, :]
            inner = 4 * np.outer(mu, mu) * second[f] - 2 * np.outer(mu * sums[f], mu**2) - 2 * np.outer(mu**2, mu * sums[f])
            q = fourth[f] + left + left.T + inner + m.n[f] * np.outer(mu**2, mu**2)
            out.append((int(fold), float(m.n[f]), m.names[:k], s.ravel(), p.ravel(), q.ravel()))
        total = sums.sum(axis=0) / m.n.sum()
        whole = second.sum(axis=0) / m.n.sum() - np.outer(total, total)
        out.append((-1, float(m.n.sum()), m.names[:k], whole.ravel(), None, None))
        return pd.DataFrame(out, columns=["fold", "n", "names", "s", "p", "q"])

    found = MO.moments(MO.centred(both, key), key, 0, folds, MO.shuffle_free_fold)
    return MO.solved(found, key, split, "fold int, n double, names array<bigint>, s array<double>, p array<double>, q array<double>").persist()


def lasso_losses(tasks: DataFrame, key: str, alphas: Iterable[float]) -> DataFrame:
    """key, fold, alpha, loss: mean squared errors of each fold's covariance against its dates' outer products over
    the upper triangle. Each (window, fold) is a task that walks the penalties downwards from fit to fit."""
    falling = sorted(map(float, alphas), reverse=True)
    kind = dict(tasks.dtypes)[key]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, fold, n, s, p, q in zip(pdf[key], pdf["fold"], pdf["n"], pdf["s"], pdf["p"], pdf["q"], strict=True):
                m = round(len(s) ** 0.5)
                upper = np.triu_indices(m)
                s, p, q = (np.array(v).reshape(m, m)[upper] if v is not s else np.array(v).reshape(m, m) for v in (s, p, q))
                for alpha, (cov, _) in zip(falling, K.glasso_path(s, falling), strict=True):
                    c = cov[upper]
                    rows.append((k, fold, alpha, float((n * c * c - 2 * c * p + q).sum()) / (n * m * (m - 1) / 2)))
            yield pd.DataFrame(rows, columns=[key, "fold", "alpha", "loss"])

    return dealt(tasks.where("fold >= 0"), key, "fold").mapInPandas(walk, f"{key} {kind}, fold int, alpha double, loss double")


def lasso_best(losses: DataFrame, key: str) -> DataFrame:
    """key, alpha, loss: the penalty of least summed loss (ties: the least)."""
    total = losses.groupBy(key, "alpha").agg(F.sum("loss").alias("loss"))
    return total.groupBy(key).agg(F.min(F.struct("loss", "alpha")).alias("b")).select(key, "b.alpha", "b.loss")


def lasso_fits(tasks: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """key, i, j, cov, prec at each window's penalty (key, alpha)."""
    kind = dict(tasks.dtypes)[key]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k, names, s, alpha in zip(pdf[key], pdf["names"], pdf["s"], pdf["alpha"], strict=True):
                cov, prec = K.glasso(np.array(s).reshape(len(names), len(names)), float(alpha))
                yield edge_rows(np.array(names), cov, **{key: k}).rename(columns={"v": "cov"}).assign(prec=prec.ravel())

    whole = tasks.where("fold = -1").select(key, "names", "s").join(F.broadcast(best.select(key, "alpha")), key)
    return dealt(whole, key).mapInPandas(fit, f"{key} {kind}, i long, j long, cov double, prec double")


def lasso_search(rows: DataFrame, key: str, alphas: Iterable[float], folds: int = 12) -> DataFrame:
    """key, i, j, cov, prec: graphical lasso of rows (key, pos, dates, permno, x) at the penalty of least
    out-of-fold loss."""
    tasks = lasso_tasks(rows, key, folds)
    return lasso_fits(tasks, lasso_best(lasso_losses(tasks, key, alphas), key), key)


def decompositions(coefs: DataFrame, covs: DataFrame, key: str, table: str, horizon: int) -> DataFrame:
    """key, i, j, v: a table of the decomposition from each window's coefficients and covariance."""
    kinds = dict(coefs.dtypes)
    left = coefs.where("term like 'lag%'").select(key, F.col("equation").alias("i"), F.col("source").alias("j"), F.substring("term", 4, 9).cast("int").alias("lag"), F.col("coef").alias("v"))
    both = left.unionByName(covs.select(key, "i", "j", F.lit(0).alias("lag"), "v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(pdf["i"])
        n = len(labels)
        ms = []
        for lag in range(int(pdf["lag"].max()) + 1):
            part = pdf[pdf["lag"] == lag]
            m = np.zeros((n, n))
            m[np.searchsorted(labels, part["i"]), np.searchsorted(labels, part["j"])] = part["v"]
            ms.append(m)
        out = edge_rows(labels, K.Decomposition(ms[1:], ms[0]).table(table, horizon))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return both.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, i long, j long, v double")


def estimate_fevd(df: DataFrame, grid: DataFrame, key: str, alphas: Iterable[float], factors: tuple[str, ...] = (), horizon: int = 21, folds: int = 12, lags: int = 1) -> DataFrame:
    """key, i, j, v: adaptive net by cross-validation with unpenalised factors, residuals, graphical
    lasso by cross-validation, decomposition table. Searches are dealt out by window and
    alpha, and by window and fold."""
    found = net_moments(df, key, folds, factors, lags)
    first = first_points(found, key, folds, factors=factors)
    best = best_point(penalised_path(found, grid, key, folds, first, factors=factors), key).persist()
    coefs = penalised_var(found, best, key, first, factors=factors)
    blocks = MO.moments(MO.complete(df, key, factors, scale=True), key, lags, folds, MO.shuffle_free_fold)
    tasks = residual_tasks(at_points(blocks, best, key, first), key).persist()
    covs = lasso_fits(tasks, lasso_best(lasso_losses(tasks, key, alphas), key), key).select(key, "i", "j", F.col("cov").alias("v"))
    return decompositions(coefs, covs, key, "fevd", horizon)


def residual_tasks(found: DataFrame, key: str) -> DataFrame:
    """lasso_tasks() of the residuals of each window's penalised fit, from the moments of its folds (with
    columns alpha, lambdau, ini): no residual is made. q, which no penalty changes, is 0."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, int(pdf.loc[pdf["kind"] == "c", "lag"].max()), False)
        if len(m.folds) < 2:
            return None
        b = fitted_net(m, pdf, 1.0, False)
        unit = np.outer(m.std, m.std)
        second = (m.yy - b.T @ m.xy - np.swapaxes(m.xy, 1, 2) @ b + b.T @ m.xx @ b) * unit
        sums = np.stack([y - x @ b for x, y in zip(*m.sums(), strict=True)]) * m.std
        out = []
        for f, fold in enumerate(m.folds):
            rest = m.n.sum() - m.n[f]
            mu = (sums.sum(axis=0) - sums[f]) / rest
            s = (second.sum(axis=0) - second[f]) / rest - np.outer(mu, mu)
            p = second[f] - np.outer(sums[f], mu) - np.outer(mu, sums[f]) + m.n[f] * np.outer(mu, mu)
            out.append((int(fold), float(m.n[f]), m.names, s.ravel(), p.ravel(), np.zeros(p.size)))
        total = sums.sum(axis=0) / m.n.sum()
        whole = second.sum(axis=0) / m.n.sum() - np.outer(total, total)
        out.append((-1, float(m.n.sum()), m.names, whole.ravel(), None, None))
        return pd.DataFrame(out, columns=["fold", "n", "names", "s", "p", "q"])

    return MO.solved(found, key, split, "fold int, n double, names array<bigint>, s array<double>, p array<double>, q array<double>")
