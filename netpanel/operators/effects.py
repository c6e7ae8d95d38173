"""Two-way fixed effects on panels with holes.

Alternating projections on entities and times, accelerated by conjugate gradients: the time effects d
solve S d = b, where (S d)_t sums n_it (d_t - mean of d over i's rows) over the cells (entity i, time t)
of n_it rows. Rows are first added up to cells, so a step reads cells, of which an entity has as many as
there are times at most, and returns one number a time; entity effects follow from means. The
driver holds vectors over times, at most MAX_TIMES long."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct times of a panel; more are an error.
MAX_TIMES = 100_000


def two_way(df: DataFrame, columns: Sequence[str], entity: str, time: str, tol: float = 1e-11, steps: int = 500) -> DataFrame:
    """df's rows with ``_c`` for each of columns: c less its entity and time effects by least squares.

    Rows that miss the entity, the time or one of columns are left out. An entity or time of one row
    has the value 0; parts of the panel that share neither entities nor times are fitted apart. An error is
    raised if the residual of the equations is not below ``tol`` of its start after ``steps`` steps."""
    spark = df.sparkSession
    rows = df.dropna(subset=[entity, time, *columns])
    found = sorted(r[0] for r in rows.select(time).distinct().limit(MAX_TIMES + 1).collect())
    if len(found) > MAX_TIMES:
        raise ValueError(f"a panel of more than {MAX_TIMES} times")
    times = F.broadcast(spark.createDataFrame([(t, k) for k, t in enumerate(found)], f"`{time}` {dict(rows.dtypes)[time]}, _t int"))
    sums = [F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)]
    cells = rows.join(times, time).groupBy(entity, "_t").agg(F.count(F.lit(1)).alias("_n"), *sums)
    cells = cells.repartition(entity).persist(StorageLevel.MEMORY_AND_DISK)
    own, m = Window.partitionBy(entity), len(columns)

    def by_time(parts: DataFrame, values: list) -> np.ndarray:  # noqa: ANN001
        out = np.zeros((len(found), len(values)))
        for r in parts.groupBy("_t").agg(*[F.sum(v).alias(f"_v{k}") for k, v in enumerate(values)]).collect():
            out[r[0]] = r[1:]
        return out

    def table(v: np.ndarray) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(k, *row) for k, row in enumerate(v.tolist())], ", ".join(["_t int", *[f"_p{k} double" for k in range(m)]])))

    def applied(p: np.ndarray) -> np.ndarray:
        met = cells.join(table(p), "_t")
        met = met.select("_t", "_n", *[(F.col(f"_p{k}") - F.sum(F.col("_n") * F.col(f"_p{k}")).over(own) / F.sum("_n").over(own)).alias(f"_q{k}") for k in range(m)])
        return by_time(met, [F.col("_n") * F.col(f"_q{k}") for k in range(m)])

    try:
        start = cells.select("_t", "_n", *[(F.col(f"_s{k}") - F.col("_n") * F.sum(f"_s{k}").over(own) / F.sum("_n").over(own)).alias(f"_b{k}") for k in range(m)])
        first = by_time(start, [F.col("_n"), *[F.col(f"_b{k}") for k in range(m)]])
        n, r = first[:, :1], first[:, 1:]
        d = np.zeros_like(r)
        z = r / np.maximum(n, 1)
        p, rz = z.copy(), (r * z).sum(axis=0)
        goal = tol**2 * rz
        # what rounding leaves of a column without time effects is nothing to be solved
        goal = np.maximum(goal, 1e-28 * by_time(cells, [F.col(f"_s{k}") ** 2 / F.col("_n") for k in range(m)]).sum(axis=0))
        for _ in range(steps):
            if (rz <= goal).all():
                break
            live = rz > goal
            sp = applied(p)
            step = np.where(live, rz / np.where(live, (p * sp).sum(axis=0), 1), 0)
            d += step * p
            r = r - step * sp
            z = r / np.maximum(n, 1)
            after = np.where(live, (r * z).sum(axis=0), rz)
            p = z + np.where(live, after / np.where(live, rz, 1), 0) * p
            rz = after
        else:
            raise RuntimeError(f"two-way effects did not converge in {steps} steps")
        effects = table(d)
        means = cells.join(effects, "_t").groupBy(entity).agg(*[(F.sum(F.col(f"_s{k}") - F.col("_n") * F.col(f"_p{k}")) / F.sum("_n")).alias(f"_a{k}") for k in range(m)])
        out = rows.join(times, time).join(effects, "_t").join(means, entity)
        return out.select(*df.columns, *[(F.col(c) - F.col(f"_p{k}") - F.col(f"_a{k}")).alias(f"_{c}") for k, c in enumerate(columns)])
    finally:
        cells.unpersist()


def two_way_fit(df: DataFrame, y: str, xs: Sequence[str], lags: int = 3, entity: str = "permno", time: str = "date") -> DataFrame:
    """term, beta, se, tstat, n: y on xs with entity and time effects. Errors are robust to correlation
    over entities and, with Bartlett weights, over ``lags`` times: scores are added up by time and the
    kernel works on that one row a time. An empty panel gives no row; regressors that the effects or each other
    explain are an error."""
    own = two_way(df, [y, *xs], entity, time)
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.sum(F.col(f"_{xs[i]}") * F.col(f"_{xs[j]}")) for i, j in pairs] + [F.sum(F.col(f"_{x}") * F.col(f"_{y}")) for x in xs] + [F.sum(F.col(x) * F.col(x)) for x in xs]
    found = sorted(own.groupBy(time).agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"_{at}") for at, p in enumerate(products)]).collect())
    schema = "term string, beta double, se double, tstat double, n long"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    v = np.array([r[2:] for r in found], float)
    xx = np.zeros((len(v), k, k))
    for at, (i, j) in enumerate(pairs):
        xx[:, i, j] = xx[:, j, i] = v[:, at]
    xy, raw = v[:, len(pairs) : len(pairs) + k], v[:, len(pairs) + k :].sum(axis=0)
    total = xx.sum(axis=0)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-300))
    if (np.diag(total) <= 1e-16 * raw).any() or np.linalg.cond(total / np.outer(scale, scale)) > 1e12:
        raise ValueError("the effects or the other regressors explain a regressor")
    back = np.linalg.inv(total)
    beta = back @ xy.sum(axis=0)
    h = xy - xx @ beta
    lagged = [(1 - a / (lags + 1)) * (h[a:].T @ h[:-a]) for a in range(1, min(lags, len(h) - 1) + 1)]
    s = reduce(np.add, [g + g.T for g in lagged], h.T @ h)
    var = np.diag(back @ s @ back)
    se = np.sqrt(np.where(var > 0, var, np.nan))
    n = sum(r[1] for r in found)
    clean = lambda a: [None if np.isnan(e) else float(e) for e in a]
    return df.sparkSession.createDataFrame(list(zip(xs, clean(beta), clean(se), clean(beta / se), [n] * k, strict=True)), schema)
