"""Statistics of searched fits: of each window's penalised vector model and of the graphical lasso on its
residuals, from the moments that the searches use. No residual is made and no row is read again."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import models as E
from . import moments as MO

SCHEMA = "statistic string, value double"


class Variation:
    """Sums of squares of a window's responses, in their own units, under coefficients of its standardised data."""

    def __init__(self, m: MO.System) -> None:
        self.m = m
        self.xx, self.xy, self.yy, self.n = m.total()
        self.sx, self.sy = (s.sum(axis=0) for s in m.sums())
        self.k = len(m.factors)

    def total(self) -> np.ndarray:
        return (np.diag(self.yy) - self.sy**2 / self.n) * self.m.std**2

    def residual(self, b: np.ndarray, centred: bool) -> np.ndarray:
        e2 = np.diag(E.residual_squares(self.m, b))
        return (e2 - (self.sy - self.sx @ b) ** 2 / self.n if centred else e2) * self.m.std**2

    def least_squares(self) -> np.ndarray:
        """With an intercept; the least-norm solution where the regressors are singular."""
        xx = self.xx - np.outer(self.sx, self.sx) / self.n
        xy = self.xy - np.outer(self.sx, self.sy) / self.n
        return np.linalg.lstsq(xx, xy, rcond=1e-12)[0]

    def part(self, b: np.ndarray, factors: bool) -> np.ndarray:
        """Only the factors' coefficients, or only the lags'."""
        out = np.zeros_like(b)
        own = slice(0, self.k) if factors else slice(self.k, None)
        out[own] = b[own]
        return out

    def shares(self, b: np.ndarray, fitted: bool) -> dict[str, float]:
        """Goodness of fit of the model, of its parts alone, and what each part adds to the other."""
        full, total = self.residual(b, True).sum(), self.total().sum()
        alone = {name: self.residual(self.part(b, name == "factors"), True).sum() for name in ("factors", "spillovers")}
        end = "" if fitted else "_ols"
        out = {f"var_r2{end}": 1 - self.residual(b, not fitted).sum() / total}
        for name, other in (("factors", "spillovers"), ("spillovers", "factors")):
            out[f"var_component_r2_{name}{end}"] = 1 - alone[name] / total
            out[f"var_partial_r2_{name}{end}"] = 1 - full / alone[other]
        return out


def train_loss(m: MO.System, pdf: pd.DataFrame) -> float:
    """Mean over folds of the mean squared error, on the dates outside the fold, of the fit to them."""
    xx, xy = m.rest()
    lam = float(pdf["lambdau"].iloc[0]) * xy.shape[2]
    coefs = K.net_path(xx, xy, [lam], float(pdf["alpha"].iloc[0]), E.weights_of(m, pdf, 1.0, False))[0]
    yy = (m.yy.sum(axis=0) - m.yy) / (m.n.sum() - m.n)[:, None, None]
    return float(np.mean([np.trace(y - 2 * b.T @ c + b.T @ a @ b) / len(y) for a, c, y, b in zip(xx, xy, yy, coefs, strict=True)]))


def statistics(found: dict[str, float]) -> pd.DataFrame:
    return pd.DataFrame({"statistic": list(found), "value": [float(v) if np.isfinite(v) else None for v in found.values()]})


def describe_var(at: DataFrame, key: str) -> DataFrame:
    """key, statistic, value of moments of folds with each window's point and error (alpha, lambdau, ini, mse)."""

    def describe(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, int(pdf.loc[pdf["kind"] == "c", "lag"].max()), False)
        if m.n.sum() + m.lags < E.LEAST:
            return None
        v = Variation(m)  # the first stage is a ridge: its kappa is 0
        b, o = E.fitted_net(m, pdf, 1.0, False), v.least_squares()
        n, k = len(m.names), v.k
        (load, own), (load_o, own_o) = ((c[1 : 1 + k], c[1 + k : 1 + k + n].T) for c in (m.own_units(b, True), m.own_units(o, True)))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = {
                "lambda": pdf["lambdau"].iloc[0], "kappa": pdf["alpha"].iloc[0], "ini_lambda": pdf["ini"].iloc[0], "ini_kappa": 0.0,
                "var_matrix_density": (own != 0).mean(), "var_mean_connection": own.mean(), "var_mean_abs_connection": np.abs(own).mean(),
                "var_asymmetry": K.asymmetry(own) if own.any() else 0.0, **v.shares(b, True), **v.shares(o, False),
                "var_df_full": b.size + n, "var_df_used": np.count_nonzero(b) + n,
                "var_nonzero_shrinkage": K.shrinkage(own, own_o, True) if own.any() else np.nan, "var_full_shrinkage": K.shrinkage(own, own_o),
                "var_cv_loss": pdf["mse"].iloc[0], "var_train_loss": train_loss(m, pdf),
            }
            if k:
                found |= {"var_factor_shrinkage": K.shrinkage(load, load_o, True) if load.any() else np.nan, "var_full_factor_shrinkage": K.shrinkage(load, load_o)}
        return statistics(found)

    return MO.solved(at, key, describe, SCHEMA)


def mean_likelihood(cov: np.ndarray, second: np.ndarray) -> float:
    """Mean normal log density, under a covariance, of data with these second moments."""
    sign, size = np.linalg.slogdet(cov)
    return -0.5 * (len(cov) * np.log(2 * np.pi) + size + np.trace(np.linalg.solve(cov, second))) if sign > 0 else np.nan


def describe_cov(tasks: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """key, statistic, value of the graphical lasso at each window's penalty (key, alpha, loss). Likelihoods are of
    the data less its means; the sample's estimate divides by the dates less one. The full degrees of freedom
    count pairs of series, the used ones the variances too."""

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        p = len(r["names"])
        s = np.array(r["s"]).reshape(p, p)
        cov, prec = K.glasso(s, float(r["alpha"]))
        sample = s * r["n"] / (r["n"] - 1)
        inverse = np.linalg.pinv(sample)
        upper = np.triu_indices(p, 1)
        return statistics({
            "rho": r["alpha"], "cov_mean_likelihood": mean_likelihood(cov, s), "cov_mean_likelihood_sample_estimate": mean_likelihood(sample, s),
            "cov_df_full": p * (p - 1) // 2, "cov_df_used": np.count_nonzero(prec[upper]) + p,
            "covar_density": (cov != 0).mean(), "precision_density": (prec != 0).mean(),
            "covar_nonzero_shrinkage": K.shrinkage(cov, sample, True), "covar_full_shrinkage": K.shrinkage(cov, sample),
            "precision_nonzero_shrinkage": K.shrinkage(prec, inverse, True), "precision_full_shrinkage": K.shrinkage(prec, inverse), "covar_cv_loss": r["loss"],
        })

    whole = tasks.where("fold = -1").select(key, "names", "s", "n").join(F.broadcast(best), key)
    return MO.solved(whole, key, describe, SCHEMA)


def describe_search(df: DataFrame, grid: DataFrame, key: str, alphas: Iterable[float], factors: tuple[str, ...] = (), folds: int = 12, lags: int = 1) -> DataFrame:
    """key, statistic, value of the searches that models.estimate_fevd() makes in each window; null where a
    statistic is not defined (the shrinkage of the nonzero coefficients if all are zero)."""
    found = E.net_moments(df, key, folds, factors, lags)
    first = E.first_points(found, key, folds, factors=factors)
    best = E.best_point(E.penalised_path(found, grid, key, folds, first, factors=factors), key).persist()
    blocks = MO.moments(MO.complete(df, key, factors, scale=True), key, lags, folds, MO.shuffle_free_fold)
    at = E.at_points(blocks, best, key, first)
    tasks = E.residual_tasks(at, key).persist()
    losses = E.lasso_best(E.lasso_losses(tasks, key, alphas), key)
    return describe_var(at.join(F.broadcast(best.select(key, "mse")), key), key).unionByName(describe_cov(tasks, losses, key))
