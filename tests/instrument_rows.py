"""Instrumental regressions on whole matrices of rows, which the sums of the library are compared with."""

import numpy as np


def k_class(y: np.ndarray, x: np.ndarray, z: np.ndarray, method: str = "2sls", fuller: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of y on x with instruments z (constants included in both), their standard
    errors (robust to many instruments) and the class's k.

    Projections come from a QR of z, so nothing of size t x t is formed."""
    t = len(y)
    q, _ = np.linalg.qr(z)
    proj = lambda m: q @ (q.T @ m)
    k = 1.0
    if method in ("liml", "fuller"):
        outside = x[:, [j for j in range(x.shape[1]) if np.linalg.norm(x[:, j] - proj(x[:, j])) > 1e-8 * np.linalg.norm(x[:, j])]]
        inside = np.column_stack([x[:, j] for j in range(x.shape[1]) if np.linalg.norm(x[:, j] - proj(x[:, j])) <= 1e-8 * np.linalg.norm(x[:, j])] or [np.zeros(t)])
        yy = np.column_stack([y, outside])
        m0 = yy - inside @ (np.linalg.pinv(inside) @ yy)
        m1 = yy - proj(yy)
        k = float(np.linalg.eigvals(np.linalg.solve(m1.T @ m1, m0.T @ m0)).real.min())
        if method == "fuller":
            k -= fuller / (t - z.shape[1])
    elif method != "2sls":
        raise ValueError(f"unknown method {method!r}")
    h = x.T @ x - k * (x.T @ (x - proj(x)))
    b = np.linalg.solve(h, x.T @ y - k * (x.T @ (y - proj(y))))
    e = y - x @ b
    xt = proj(x) if method == "2sls" else x - np.outer(e, (e @ x) / (e @ e))
    alpha = float((e @ proj(e)) / (e @ e))
    meat = (e @ e) / t * ((1 - alpha) ** 2 * xt.T @ proj(xt) + alpha**2 * xt.T @ (xt - proj(xt))) if method != "2sls" else (e @ e) / (t - x.shape[1]) * h
    inv = np.linalg.inv(h)
    return b, np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0)), k
