"""The spillover model of netpanel.operators.spillover fitted from the rows, as a yardstick for the tests."""

from __future__ import annotations

import math

import numpy as np

from netpanel.functions.kernels import chi2_sf, ols


class Spillover:
    """r = a + B f + c W r + e with a network W of zero diagonal and one scalar c.

    W and the data are (n x n), returns (t x n), factors (t x k)."""

    def __init__(self, network: np.ndarray, returns: np.ndarray, factors: np.ndarray) -> None:
        self.w = network - np.diag(np.diag(network))
        self.r, self.f = returns, factors
        self.t, self.n = returns.shape
        self.x = np.hstack([np.ones((self.t, 1)), factors])
        self.wr = returns @ self.w.T
        hat = self.x @ np.linalg.pinv(self.x)
        self.r0, self.wr0 = returns - hat @ returns, self.wr - hat @ self.wr
        radius = float(np.abs(np.linalg.eigvals(self.w)).max())
        self.limit = 0.9999 / radius if radius > 0 else np.inf

    def _finish(self, c: float) -> Spillover:
        self.c = float(c)
        b = ols(self.x, self.r - self.c * self.wr)
        self.alpha, self.beta = b[0], b[1:].T
        self.inverse = np.linalg.inv(self.structural)
        return self

    @property
    def structural(self) -> np.ndarray:
        return np.eye(self.n) - self.c * self.w

    def fit_ols(self) -> Spillover:
        """Pooled least squares; the intercepts and loadings are partialled out by asset."""
        return self._finish((self.r0 * self.wr0).sum() / (self.wr0**2).sum())

    def fit_wls(self) -> Spillover:
        v = 1 / self.r.var(axis=0, ddof=1)
        return self._finish((v * (self.r0 * self.wr0).sum(axis=0)).sum() / (v * (self.wr0**2).sum(axis=0)).sum())

    def log_likelihood(self, c: float) -> float:
        """Concentrated over intercepts, loadings and residual variances."""
        sign, logdet = np.linalg.slogdet(np.eye(self.n) - c * self.w)
        if sign <= 0:
            return -np.inf
        s2 = ((self.r0 - c * self.wr0) ** 2).mean(axis=0)
        return float(self.t * logdet - self.t / 2 * np.log(s2).sum() - self.t * self.n / 2 * (math.log(2 * math.pi) + 1))

    def fit_mle(self, no_spillovers: bool = False) -> Spillover:
        if no_spillovers:
            return self._finish(0.0)
        low, high = -min(self.limit, 1e3) * 3, min(self.limit, 1e3)
        grid = np.linspace(low, high, 81)
        at = int(np.argmax([self.log_likelihood(c) for c in grid]))
        a, b = grid[max(at - 1, 0)], grid[min(at + 1, 80)]
        ratio = (math.sqrt(5) - 1) / 2
        while b - a > 1e-10 * (1 + abs(a)):
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            if self.log_likelihood(c) > self.log_likelihood(d):
                b = d
            else:
                a = c
        return self._finish((a + b) / 2)

    def standard_error(self) -> float:
        """Of c, from the curvature of the concentrated likelihood."""
        h = 1e-4 * (1 + abs(self.c))
        curve = (self.log_likelihood(self.c + h) - 2 * self.log_likelihood(self.c) + self.log_likelihood(self.c - h)) / h**2
        return float(math.sqrt(-1 / curve)) if curve < 0 else float("nan")

    def residuals(self) -> np.ndarray:
        return self.r @ self.structural.T - self.x @ np.vstack([self.alpha, self.beta.T])

    def wald(self) -> tuple[float, float]:
        """Statistic and p-value of c = 0."""
        z = (self.c / self.standard_error()) ** 2
        return float(z), chi2_sf(float(z), 1)

    @property
    def n_params(self) -> int:
        return int(np.count_nonzero(self.alpha) + np.count_nonzero(self.beta) + (self.c != 0) + self.n)

    def aic(self) -> float:
        return 2 * (self.n_params - self.log_likelihood(self.c))

    def likelihood_ratio(self) -> tuple[float, float]:
        """Restricted against reduced-form residual covariance."""
        e = self.residuals()
        restricted = self.inverse @ np.diag(e.var(axis=0, ddof=1)) @ self.inverse.T
        reduced = np.cov(self.r0, rowvar=False)
        stat = self.t * (np.linalg.slogdet(restricted)[1] - np.linalg.slogdet(reduced)[1])
        return float(stat), chi2_sf(float(stat), max(1.0, self.n * (self.n + 1) / 2 - self.n_params))

    def predict(self, factors: bool = True, spillovers: bool = True) -> np.ndarray:
        out = np.tile(self.alpha, (self.t, 1))
        if factors:
            out = out + self.f @ self.beta.T
        return out + self.c * self.wr if spillovers else out

    def partial_r2(self) -> dict[str, float]:
        def ss(e: np.ndarray) -> float:
            return float(((e - e.mean(axis=0)) ** 2).sum())

        full = ss(self.r - self.predict())
        return {
            "r2": 1 - full / ss(self.r),
            "factors": 1 - full / ss(self.r - self.predict(factors=False)),
            "spillovers": 1 - full / ss(self.r - self.predict(spillovers=False)),
        }

    def premia(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Common and granular risk premia, exposures and expected returns."""
        eta = self.residuals().var(axis=0, ddof=1)
        cov_f = np.atleast_2d(np.cov(self.f, rowvar=False))
        common = weights @ self.inverse @ self.beta @ np.diag(np.diag(cov_f))
        granular = weights @ self.inverse * eta
        own = np.diag(np.diag(self.inverse))
        return {
            "granular_premium": granular, "exposure": weights @ self.inverse,
            "expected_common": self.inverse @ self.beta @ common, "expected_granular": self.inverse @ granular,
            "expected_self": own @ granular, "expected_others": (self.inverse - own) @ granular,
        }

    def variance_parts(self) -> dict[str, np.ndarray]:
        eta = np.diag(self.residuals().var(axis=0, ddof=1))
        loadings = self.inverse @ self.beta
        own = np.diag(np.diag(self.inverse))
        other = self.inverse - own
        return {
            "common": loadings @ np.atleast_2d(np.cov(self.f, rowvar=False)) @ loadings.T,
            "spillover": other @ eta @ other.T + own @ eta @ other.T + other @ eta @ own.T,
            "idiosyncratic": own @ eta @ own.T,
        }
