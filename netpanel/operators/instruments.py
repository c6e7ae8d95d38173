"""Instrumental regressions from sums: two-stage least squares, limited information, Fuller's
correction with errors for many instruments, and the jackknife form of it that stays right
under heteroskedasticity (Hausman, Newey, Woutersen, Chao and Swanson, 2012).

The rows of a group are packed into blocks of about BLOCK rows, and each pass over the blocks gives
sums that Spark adds up; a task never holds a group. One pass gives the products of all columns. The
many-instrument errors take a second one (leverages of the instruments, by the triangular root of
their products, and fourth moments), the jackknife form two: leverages for the estimate, then
residuals for its errors. The sum over all pairs of rows in these errors, of squared projection
weights, is a sum of squares of K x K sums over rows, with the instruments made orthonormal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import scratch

#: Rows of a block.
BLOCK = 4096
METHODS = ("2sls", "liml", "fuller", "hful")


class Layout:
    """Places in a block's columns: the response, a constant, regressors, and instruments that are no regressors."""

    def __init__(self, x: Sequence[str], z: Sequence[str]) -> None:
        rest = [c for c in z if c not in x]
        self.columns = [*x, *rest]
        place = {c: 2 + i for i, c in enumerate(self.columns)}
        self.width = 2 + len(self.columns)
        self.x = [1, *(place[c] for c in x)]
        self.z = [1, *(place[c] for c in z)]
        #: regressors that are among the instruments
        self.inside = [1, *(place[c] for c in x if c in z)]
        self.outside = [place[c] for c in x if c not in z]
        self.terms = ["const", *x]


def blocks(df: DataFrame, y: str, layout: Layout, by: str, keys: Sequence[str], fn: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """by, n, means, block: complete rows less their group's means, a block's as packed doubles. ``keys``
    and the values deal the rows of a group to its blocks. With ``fn`` what it makes of each block, v, instead."""
    values = [y, *layout.columns]
    # one array a row: with a column each, the optimiser's constraints grow out of memory beyond thirty instruments
    rows = df.where(F.col(by).isNotNull()).select(by, *keys, F.array(*[F.col(c).cast("double") for c in values]).alias("_w"))
    rows = rows.where(F.forall("_w", lambda v: v.isNotNull()))
    stats = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("_w")[i]) for i in range(len(values))]).alias("means"))
    part = F.pmod(F.xxhash64(*keys, "_w"), F.ceil(F.col("n") / BLOCK)).alias("part")
    dealt = rows.join(stats, by).select(by, part, "n", "means", "_w")

    def pack(table: pa.Table) -> pa.Table:
        own = np.array(table.column("_w").combine_chunks().flatten().to_numpy()).reshape(table.num_rows, -1) - np.array(table.column("means")[0].as_py())
        block = np.insert(own, 1, 1.0, axis=1)
        made = ("v", pa.array([fn(block, np.empty(0))], pa.list_(pa.float64()))) if fn else ("block", pa.array([block.tobytes()], pa.binary()))
        return table.slice(0, 1).select([by, "n", "means"]).append_column(*made)

    kind = "v array<double>" if fn else "block binary"
    return dealt.groupBy(by, "part").applyInArrow(pack, f"{by} {dict(df.dtypes)[by]}, n long, means array<double>, {kind}")


def added(held: DataFrame, by: str, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """by, n, means, v: fn of each block (and of the doubles packed in the column given, if it has one),
    added up over the blocks of a group."""
    given = "given" in held.columns
    kind = dict(held.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("given") if given else [pa.scalar(b"")] * b.num_rows
            # a block is looked at where it lies in the batch
            sums = [fn(np.frombuffer(raw.as_buffer()).reshape(-1, width), np.frombuffer(g.as_buffer())) for raw, g in zip(b.column("block"), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("n"), b.column("means"), pa.array(sums, pa.list_(pa.float64()))], names=[by, "n", "means", "v"])

    return summed(held.mapInArrow(run, f"{by} {kind}, n long, means array<double>, v array<double>"), by)


def summed(parts: DataFrame, by: str) -> DataFrame:
    """by, n, means, v: the arrays v of each group, added up by place."""
    sums = parts.select(by, "n", "means", F.posexplode("v").alias("pos", "s")).groupBy(by, "pos").agg(F.sum("s").alias("s"), F.first("n").alias("n"), F.first("means").alias("means"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda c: c["s"])  # as many as fn returns
    return sums.groupBy(by).agg(F.first("n").alias("n"), F.first("means").alias("means"), ordered.alias("v"))


def products(w: np.ndarray, _: np.ndarray) -> np.ndarray:
    return (w.T @ w).ravel()


class Projection:
    """Cross products of a group's columns, and those of their projections on the instruments."""

    def __init__(self, v: Sequence[float], layout: Layout) -> None:
        self.layout = layout
        self.ww = np.array(v, float)[: layout.width**2].reshape(layout.width, layout.width)
        zz = self.ww[np.ix_(layout.z, layout.z)]
        scale = 1 / np.sqrt(np.maximum(np.diag(zz), 1e-300))
        scaled = zz * np.outer(scale, scale)
        own = self.ww[np.ix_(layout.x, layout.x)]
        unit = 1 / np.sqrt(np.maximum(np.diag(own), 1e-300))
        self.singular = bool(np.linalg.cond(scaled) > 1e12 or np.linalg.cond(own * np.outer(unit, unit)) > 1e12)
        #: instruments times this are orthonormal
        self.root = np.zeros_like(zz) if self.singular else scale[:, None] * np.linalg.inv(np.linalg.cholesky(scaled)).T
        half = self.root.T @ self.ww[layout.z]
        self.wpw = half.T @ half
        self.half = half

    def full(self, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
        return self.ww[np.ix_(a, b)]

    def projected(self, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
        return self.wpw[np.ix_(a, b)]

    def k(self, method: str, n: int, c: float) -> float:
        """The class's k: 1, the least variance ratio, or that less c / (rows - instruments)."""
        if method == "2sls":
            return 1.0
        la = self.layout
        own = [0, *la.outside]
        partial = self.full(own, own) - self.full(own, la.inside) @ np.linalg.solve(self.full(la.inside, la.inside), self.full(la.inside, own))
        least = float(np.linalg.eigvals(np.linalg.solve(self.full(own, own) - self.projected(own, own), partial)).real.min())
        return least - c / (n - len(la.z)) if method == "fuller" else least

    def estimate(self, k: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and the matrix they solve."""
        x = self.layout.x
        h = (1 - k) * self.full(x, x) + k * self.projected(x, x)
        return np.linalg.solve(h, (1 - k) * self.full(x, [0])[:, 0] + k * self.projected(x, [0])[:, 0]), h

    def contrast(self, b: np.ndarray) -> np.ndarray:
        """Columns times this are the residuals."""
        c = np.zeros(self.layout.width)
        c[0] = 1.0
        c[self.layout.x] -= b
        return c

    def cleaned(self, b: np.ndarray) -> np.ndarray:
        """(columns x regressors): columns times this are the regressors less their regression on the residuals."""
        c = self.contrast(b)
        pick = np.zeros((self.layout.width, len(b)))
        pick[self.layout.x, range(len(b))] = 1.0
        return pick - np.outer(c, (c @ self.ww)[self.layout.x] / (c @ self.ww @ c))


def jackknife(v: Sequence[float], n: int, layout: Layout, c: float) -> tuple[Projection, float, np.ndarray, np.ndarray]:
    """Projection, alpha, coefficients and their matrix, from the products and, after them, those weighted by leverage."""
    p = Projection(v, layout)
    own = [0, *layout.x]
    weighted = np.array(v[layout.width**2 :], float).reshape(len(own), len(own))
    hollow = p.projected(own, own) - weighted
    least = float(np.linalg.eigvals(np.linalg.solve(p.full(own, own), hollow)).real.min())
    alpha = (least - (1 - least) * c / n) / (1 - (1 - least) * c / n)
    h = hollow[1:, 1:] - alpha * p.full(layout.x, layout.x)
    return p, alpha, np.linalg.solve(h, hollow[1:, 0] - alpha * p.full(layout.x, [0])[:, 0]), h


def _uncentred(b: np.ndarray, cov: np.ndarray, means: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and errors in the columns' own units: only the constant differs."""
    back = np.eye(k)
    back[0, 1:] = -means[1:k]
    b = back @ b
    b[0] += means[0]
    return b, np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0))


def regress(df: DataFrame, y: str, x: Sequence[str], z: Sequence[str], by: str, method: str = "2sls", keys: Sequence[str] = (), errors: str = "plain", c: float = 1.0) -> DataFrame:
    """by, term, coef, se, k of y on x with instruments z (a name in both is its own instrument), by group;
    a constant is added to both.

    method: 2sls, liml, fuller or hful; k is the class's k, of hful its alpha; ``c`` is Fuller's constant.
    errors: plain (2sls: homoskedastic; liml and fuller: Bekker's) or many (liml and fuller: with the
    terms for third and fourth moments of Hansen, Hausman and Newey, 2008); hful has its own.
    Defined cases: rows with a null group or value are left out; groups of at most max(x, z) + 2 rows
    are absent; groups with singular instruments or regressors have null coef, se and k."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if errors not in ("plain", "many") or (errors == "many" and method not in ("liml", "fuller")):
        raise ValueError(f"no errors {errors!r} of {method!r}")
    if len(set(z)) < len(set(x)):
        raise ValueError(f"{len(z)} instruments for {len(x)} regressors")
    la = Layout(list(dict.fromkeys(x)), list(dict.fromkeys(z)))
    k, width, kz = len(la.x), la.width, len(la.z)
    once = method != "hful" and errors == "plain"
    held = blocks(df, y, la, by, keys, products if once else None).where(F.col("n") > max(len(x), len(z)) + 2)
    if not once:  # read by each pass
        path = scratch(df.sparkSession, "blocks")
        held.write.parquet(path)
        held = df.sparkSession.read.parquet(path)
    schema = f"{by} {dict(df.dtypes)[by]}, term string, coef double, se double, k double"

    def finish(sums: DataFrame, fn: Callable[[pd.Series], tuple[np.ndarray, np.ndarray, float] | None]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out: dict[str, list] = {c: [] for c in (by, "term", "coef", "se", "k")}
                for r in pdf.to_dict("records"):
                    found = fn(r)
                    b, se = _uncentred(found[0], found[1], np.array(r["means"], float), k) if found else ([None] * k, [None] * k)
                    for c, values in zip(out, ([r[by]] * k, la.terms, b, se, [found[2] if found else None] * k), strict=True):
                        out[c].extend(values)
                yield pd.DataFrame(out)

        return sums.mapInPandas(run, schema)

    def pass_on(sums: DataFrame, fn: Callable[[pd.Series], np.ndarray]) -> DataFrame:
        """The blocks with what fn makes of their group's sums, packed, and the sums themselves."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({by: pdf[by], "given": [np.asarray(fn(r), float).tobytes() for _, r in pdf.iterrows()]})

        made = sums.mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, given binary")
        return held.join(made, by)

    def also(sums: DataFrame, more: DataFrame) -> DataFrame:
        return sums.join(more.select(by, F.col("v").alias("_more")), by).withColumn("v", F.concat("v", "_more")).drop("_more")

    first = summed(held, by) if once else added(held, by, products, width)

    def plain(r: pd.Series) -> tuple[np.ndarray, np.ndarray, float] | None:
        p, n = Projection(r["v"], la), int(r["n"])
        if p.singular:
            return None
        kk = p.k(method, n, c)
        b, h = p.estimate(kk)
        e = p.contrast(b)
        ee, inv = float(e @ p.ww @ e), np.linalg.inv(h)
        if method == "2sls":
            return b, ee / (n - k) * inv, kk
        alpha, cl = float(e @ p.wpw @ e) / ee, p.cleaned(b)
        meat = ee / n * ((1 - alpha) ** 2 * cl.T @ p.wpw @ cl + alpha**2 * cl.T @ (p.ww - p.wpw) @ cl)
        return b, inv @ meat @ inv, kk

    if once:
        return finish(first, plain)

    path = scratch(df.sparkSession, "products")
    first.write.parquet(path)
    first = df.sparkSession.read.parquet(path)

    if errors == "many":

        def moments_given(r: pd.Series) -> np.ndarray:
            p = Projection(r["v"], la)
            if p.singular:
                return np.zeros(kz * kz + width + 2 * width * k)
            b, _ = p.estimate(p.k(method, int(r["n"]), c))
            cl = p.cleaned(b)
            spread = np.zeros((width, width))
            spread[la.z] = p.root @ p.half  # columns times this are their projections' coefficients on the instruments
            fitted = spread[:, la.x]
            return np.concatenate([p.root.ravel(), p.contrast(b), (cl - spread @ cl).ravel(), fitted.ravel()])

        def moments(w: np.ndarray, g: np.ndarray) -> np.ndarray:
            root, rest = g[: kz * kz].reshape(kz, kz), g[kz * kz :]
            u, v, fitted = w @ rest[:width], w @ rest[width : width + width * k].reshape(width, k), w @ rest[width + width * k :].reshape(width, k)
            lever = ((w[:, la.z] @ root) ** 2).sum(axis=1)
            u2 = u * u
            return np.concatenate([[(lever**2).sum()], lever @ fitted, fitted.sum(axis=0), u2 @ v, ((v * u2[:, None]).T @ v).ravel(), (v.T @ v).ravel()])

        second = added(pass_on(first, moments_given), by, moments, width)

        def many(r: pd.Series) -> tuple[np.ndarray, np.ndarray, float] | None:
            v, n = np.array(r["v"], float), int(r["n"])
            p = Projection(v, la)
            if p.singular:
                return None
            kk = p.k(method, n, c)
            b, h = p.estimate(kk)
            e, cl = p.contrast(b), p.cleaned(b)
            ee = float(e @ p.ww @ e)
            alpha, sigma2 = float(e @ p.wpw @ e) / ee, ee / (n - k)
            rest = v[width**2 :]
            lever2, lf, f, uv, uvv, vv = rest[0], rest[1 : 1 + k], rest[1 + k : 1 + 2 * k], rest[1 + 2 * k : 1 + 3 * k], rest[1 + 3 * k : 1 + 3 * k + k * k].reshape(k, k), rest[1 + 3 * k + k * k :].reshape(k, k)
            tau, kappa = kz / n, lever2 / kz
            a = np.outer(lf - tau * f, uv / n)
            extra = kz * (kappa - tau) / (n * (1 - 2 * tau + kappa * tau)) * (uvv - sigma2 * vv)
            meat = sigma2 * ((1 - alpha) ** 2 * cl.T @ p.wpw @ cl + alpha**2 * cl.T @ (p.ww - p.wpw) @ cl) + a + a.T + extra
            # the matrix of the estimate is that of alpha but for a factor of (1 - alpha)
            inv = np.linalg.inv(p.projected(la.x, la.x) - alpha * p.full(la.x, la.x))
            return b, inv @ meat @ inv, kk

        return finish(also(first, second), many)

    own = [0, *la.x]

    def weighted(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        lever = ((w[:, la.z] @ g.reshape(kz, kz)) ** 2).sum(axis=1)
        return ((w[:, own] * lever[:, None]).T @ w[:, own]).ravel()

    second = also(first, added(pass_on(first, lambda r: Projection(r["v"], la).root.ravel()), by, weighted, width))
    path = scratch(df.sparkSession, "leverages")
    second.write.parquet(path)
    second = df.sparkSession.read.parquet(path)

    def residuals_given(r: pd.Series) -> np.ndarray:
        if Projection(r["v"], la).singular:
            return np.zeros(kz * kz + width + width * k)
        p, _, b, _ = jackknife(r["v"], int(r["n"]), la, c)
        return np.concatenate([p.root.ravel(), p.contrast(b), p.cleaned(b).ravel(), (p.half @ p.cleaned(b)).ravel()])

    def residuals(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        q = w[:, la.z] @ g[: kz * kz].reshape(kz, kz)
        rest = g[kz * kz :]
        e, xh = w @ rest[:width], w @ rest[width : width + width * k].reshape(width, k)
        dot = q @ rest[width + width * k :].reshape(kz, k) if len(rest) > width + width * k else np.zeros_like(xh)
        lever, e2 = (q**2).sum(axis=1), (e * e)[:, None]
        cross = (xh * (e2[:, 0] * lever)[:, None]).T @ dot
        pairs = [(q * (xh[:, j] * e)[:, None]).T @ q for j in range(k)]
        return np.concatenate([((dot * e2).T @ dot - cross - cross.T).ravel(), *(m.ravel() for m in pairs)])

    third = added(pass_on(second, residuals_given), by, residuals, width)

    def hful(r: pd.Series) -> tuple[np.ndarray, np.ndarray, float] | None:
        v, n = np.array(r["v"], float), int(r["n"])
        if Projection(v, la).singular:
            return None
        at = width**2 + len(own) ** 2
        _, alpha, b, h = jackknife(v[:at], n, la, c)
        meat = v[at : at + k * k].reshape(k, k)
        pairs = v[at + k * k :].reshape(k, kz * kz)
        inv = np.linalg.inv(h)
        return b, inv @ (meat + pairs @ pairs.T) @ inv.T, alpha

    return finish(also(second, third), hful)
