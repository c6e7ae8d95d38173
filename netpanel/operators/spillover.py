"""Return spillovers r = a + B f + c W r + e with a network W and one scalar c, by window.

Spark adds up the second moments of returns and factors of each window (moments.py, no lags); W r is
linear in r, so these moments give every estimator, likelihood and share of variance, and no task
holds a row of the panel. The log-determinant of I - c W comes from W's eigenvalues, found once a task."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import chi2_sf
from . import moments as MO

#: Series that a network may have.
MAX_ASSETS = 1000
#: Points at which the search for the likelihood's maximum starts.
GRID = 81


class Network:
    """W without its diagonal, its labels, its eigenvalues and the bound of c within which I - c W is regular.
    The eigenvalues are found where they are first asked for: in a task, once for all of its windows."""

    def __init__(self, labels: np.ndarray, w: np.ndarray) -> None:
        self.labels, self.w = labels, w - np.diag(np.diag(w))

    @cached_property
    def eigenvalues(self) -> np.ndarray:
        return np.linalg.eigvals(self.w)

    @cached_property
    def limit(self) -> float:
        radius = float(np.abs(self.eigenvalues).max(initial=0.0))
        return 0.9999 / radius if radius > 0 else np.inf

    @classmethod
    def of(cls, edges: DataFrame) -> Network:
        """The network of edges (i, j, v), which all windows share; more than MAX_ASSETS series are an error."""
        rows = edges.select("i", "j", "v").limit(MAX_ASSETS**2 + 1).toPandas()
        labels = np.unique(rows["i"])
        if len(rows) > MAX_ASSETS**2 or len(labels) > MAX_ASSETS:
            raise ValueError(f"a network of more than {MAX_ASSETS} series")
        rows = rows[rows["j"].isin(labels)]
        w = np.zeros((len(labels), len(labels)))
        w[np.searchsorted(labels, rows["i"]), np.searchsorted(labels, rows["j"])] = rows["v"]
        return cls(labels, w)


class Model:
    """One window's model: t dates, mean (n) and factor_mean (k), and sums over the dates of products of
    centred returns rr (n x n), factors with returns fr (k x n) and factors ff (k x k).

    ``intercepts`` and ``loadings`` say whether a and B are free; either left out is 0."""

    def __init__(self, net: Network, t: int, mean: np.ndarray, factor_mean: np.ndarray, rr: np.ndarray, fr: np.ndarray, ff: np.ndarray, intercepts: bool = True, loadings: bool = True) -> None:
        self.net, self.w, self.t, self.n = net, net.w, t, len(mean)
        self.mean, self.factor_mean, self.rr, self.fr, self.ff = mean, factor_mean, rr, fr, ff
        self.intercepts, self.loadings = intercepts, loadings
        k = len(factor_mean) if loadings else 0
        self.k = k + intercepts
        # regressors: the constant, if free, then the factors, if free; with raw sums of products
        x_mean = np.concatenate([np.ones(int(intercepts)), factor_mean[:k]])
        self.xx, xr = t * np.outer(x_mean, x_mean), t * np.outer(x_mean, mean)
        at = slice(int(intercepts), None)
        self.xx[at, at] += ff[:k, :k]
        xr[at] += fr[:k]
        # reduced form r = x g: on centred sums where there is a constant, since raw ones cancel
        if intercepts:
            slope = np.linalg.pinv(ff[:k, :k]) @ fr[:k]
            self.g = np.vstack([mean - factor_mean[:k] @ slope, slope])
            self.e = rr - fr[:k].T @ slope
        else:
            self.g = np.linalg.pinv(self.xx) @ xr
            self.e = rr + t * np.outer(mean, mean) - xr.T @ self.g
        self.e_mean = mean - x_mean @ self.g
        ew = self.e @ self.w.T
        self.own, self.cross, self.lagged = np.diag(self.e), np.diag(ew), np.einsum("ij,ji->i", self.w, ew)
        self.xw = xr @ self.w.T

    @classmethod
    def of_moments(cls, net: Network, m: MO.System, **free: bool) -> Model:
        xx, xy, yy, n = m.total()
        return cls(net, int(n), m.mean, m.factor_mean, yy, xy[1:], xx[1:, 1:], **free)

    # --- estimates ---

    def at(self, c: float) -> Model:
        """The model at this c; a and B follow."""
        self.c = float(c)
        self.structural = np.eye(self.n) - self.c * self.w
        self.inverse = np.linalg.inv(self.structural)
        b = self.g @ self.structural.T
        self.alpha = b[0] if self.intercepts else np.zeros(self.n)
        self.beta = b[int(self.intercepts) :].T if self.loadings else np.zeros((self.n, len(self.factor_mean)))
        return self

    def fit_ols(self) -> Model:
        """Pooled least squares."""
        return self.at(self.cross.sum() / self.lagged.sum())

    def fit_wls(self) -> Model:
        """Weights are the inverse variances of the returns."""
        v = 1 / np.diag(self.rr)
        return self.at((v * self.cross).sum() / (v * self.lagged).sum())

    def fit_mle(self, spillovers: bool = True, unconstrained: bool = False) -> Model:
        """c of the largest likelihood below the network's limit, where the determinant is positive;
        ``unconstrained``: with any determinant but 0, within ten times the limit on both sides;
        without ``spillovers`` c is 0."""
        if not spillovers:
            return self.at(0.0)
        limit = min(self.net.limit, 1e3)
        grid = np.linspace(-3 * limit, limit, GRID)
        if unconstrained:
            grid = np.unique(np.concatenate([grid, np.linspace(-10 * limit, 10 * limit, 10 * GRID)]))
        value = lambda c: self.log_likelihood(c, any_sign=unconstrained)
        best = max(range(len(grid)), key=lambda k: value(grid[k]))
        uphill = 1 if self.score(grid[best]) > 0 else -1
        low = grid[best]
        high = grid[min(max(best + uphill, 0), len(grid) - 1)]
        while abs(high - low) > 1e-12 * (1 + abs(low)):  # low climbs towards the maximum, high is beyond it
            mid = (low + high) / 2
            if uphill * self.score(mid) > 0 and value(mid) >= value(low):
                low = mid
            else:
                high = mid
        return self.at(low)

    def squares(self, c: float) -> np.ndarray:
        """Sums of squared residuals by asset, intercepts and loadings being free."""
        return np.maximum(self.own - 2 * c * self.cross + c * c * self.lagged, 1e-300)

    def log_likelihood(self, c: float, any_sign: bool = False) -> float:
        """Concentrated over intercepts, loadings and residual variances. -inf where the determinant is 0 or,
        but for ``any_sign``, negative."""
        d = 1 - c * self.net.eigenvalues
        real = np.abs(d.imag) < 1e-12 * np.maximum(np.abs(d), 1e-12)  # complex ones come in pairs, of positive product
        if np.any(d == 0) or (not any_sign and np.count_nonzero(d.real[real] < 0) % 2):
            return -np.inf
        return float(self.t * np.log(np.abs(d)).sum() - self.t / 2 * np.log(self.squares(c) / self.t).sum() - self.t * self.n / 2 * (math.log(2 * math.pi) + 1))

    def score(self, c: float) -> float:
        """Slope of the concentrated log-likelihood."""
        lam = self.net.eigenvalues
        return float(-self.t * (lam / (1 - c * lam)).sum().real + self.t * ((self.cross - c * self.lagged) / self.squares(c)).sum())

    # --- errors and tests ---

    def standard_errors(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Of c (nan without curvature), a and B (n x k), from the observed information of the
        likelihood concentrated over the residual variances; nan for what is not free."""
        lam, s2 = self.net.eigenvalues, self.squares(self.c) / self.t
        slope = -2 * (self.cross - self.c * self.lagged) / self.t
        back = np.linalg.pinv(self.xx)
        curvature = self.t * (lam**2 / (1 - self.c * lam) ** 2).sum().real + (self.lagged / s2).sum() - self.t / 2 * ((slope / s2) ** 2).sum()
        return self._errors(curvature, back, back @ self.xw, s2)

    def pooled_errors(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Of c, a and B as least squares on the stacked regressors gives them."""
        s2 = self.squares(self.c).sum() / (self.t * self.n - self.n * self.k - 1)
        back = np.linalg.pinv(self.xx)
        return self._errors(self.lagged.sum() / s2, back, back @ self.xw, np.full(self.n, s2))

    def _errors(self, curvature: float, back: np.ndarray, load: np.ndarray, s2: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        var = 1 / curvature if curvature > 0 else np.nan
        rest = np.sqrt(s2 * np.diag(back)[:, None] + load**2 * var)
        k = int(self.intercepts)
        alpha = rest[0] if k else np.full(self.n, np.nan)
        return math.sqrt(var), alpha, rest[k:].T if self.loadings else np.full((self.n, len(self.factor_mean)), np.nan)

    def wald(self) -> tuple[float, float]:
        """Statistic and p-value of c = 0."""
        z = (self.c / self.standard_errors()[0]) ** 2
        return float(z), chi2_sf(float(z), 1)

    @property
    def n_params(self) -> int:
        return int(np.count_nonzero(self.alpha) + np.count_nonzero(self.beta) + (self.c != 0) + self.n)

    def aic(self) -> float:
        return 2 * (self.n_params - self.log_likelihood(self.c))

    def residual_variances(self) -> np.ndarray:
        return (self.squares(self.c) - self.t * (self.structural @ self.e_mean) ** 2) / (self.t - 1)

    def likelihood_ratio(self) -> tuple[float, float]:
        """Restricted against reduced-form residual covariance."""
        restricted = self.inverse @ np.diag(self.residual_variances()) @ self.inverse.T
        reduced = (self.e - self.t * np.outer(self.e_mean, self.e_mean)) / (self.t - 1)
        stat = self.t * (np.linalg.slogdet(restricted)[1] - np.linalg.slogdet(reduced)[1])
        return float(stat), chi2_sf(float(stat), max(1.0, self.n * (self.n + 1) / 2 - self.n_params))

    # --- shares and premia ---

    def partial_r2(self) -> dict[str, float]:
        full = float(self.residual_variances().sum() * (self.t - 1))
        no_factors = float(np.einsum("ij,jk,ik->", self.structural, self.rr, self.structural))
        no_spillovers = float(np.trace(self.rr) - 2 * (self.beta * self.fr.T).sum() + np.einsum("ij,jk,ik->", self.beta, self.ff, self.beta))
        return {"r2": 1 - full / float(np.trace(self.rr)), "factors": 1 - full / no_factors, "spillovers": 1 - full / no_spillovers}

    def premia(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Common and granular risk premia, exposures and expected returns."""
        eta = self.residual_variances()
        common = weights @ self.inverse @ self.beta @ np.diag(np.diag(self.ff / (self.t - 1)))
        granular = weights @ self.inverse * eta
        own = np.diag(np.diag(self.inverse))
        return {
            "granular_premium": granular, "exposure": weights @ self.inverse,
            "expected_common": self.inverse @ self.beta @ common, "expected_granular": self.inverse @ granular,
            "expected_self": own @ granular, "expected_others": (self.inverse - own) @ granular,
        }

    def variance_parts(self) -> dict[str, np.ndarray]:
        eta = np.diag(self.residual_variances())
        loadings = self.inverse @ self.beta
        own = np.diag(np.diag(self.inverse))
        other = self.inverse - own
        return {
            "common": loadings @ (self.ff / (self.t - 1)) @ loadings.T,
            "spillover": other @ eta @ other.T + own @ eta @ other.T + other @ eta @ own.T,
            "idiosyncratic": own @ eta @ own.T,
        }


def fitted(df: DataFrame, network: DataFrame, key: str, fit: Callable[[Callable[..., Model]], pd.DataFrame], schema: str, factors: tuple[str, ...] = ("mkt",)) -> DataFrame:
    """fit's rows for each window of df (key, date, permno, x and the factors): it is given a function that
    makes the window's Model, with ``intercepts`` and ``loadings`` as options.

    The series are those of the network (i, j, v); a date on which a series or factor misses is left out,
    and a window that lacks a series, has under 8 dates or fewer dates than three more than factors gives no row."""
    net = Network.of(network)
    rows = df.where(F.col("permno").isin(net.labels.tolist())).dropna(subset=list(factors))

    def run(pdf: pd.DataFrame) -> pd.DataFrame | None:
        m = MO.System(pdf, 0, True)
        if m.n.sum() < max(8, len(factors) + 3) or not np.array_equal(m.names, net.labels):
            return None
        return fit(lambda **free: Model.of_moments(net, m, **free))

    return MO.solved(MO.moments(MO.complete(rows, key, factors), key, 0), key, run, schema)
