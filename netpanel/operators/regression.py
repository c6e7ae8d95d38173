"""Regressions from sums: the cluster adds up Gram matrices, tasks solve the small systems."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import ratio


def grid(spark: SparkSession, values: dict[str, Sequence[float]]) -> DataFrame:
    """All combinations, one row each: a table of a few hundred rows."""
    return spark.createDataFrame(list(product(*values.values())), ", ".join(f"{k} double" for k in values))


def gram(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, n, xx (row-major, a constant first), xy, yy of the complete rows of each group."""
    cols: list[Column] = [F.lit(1.0), *map(F.col, xs)]
    k = len(cols)
    full = df.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    sums = [F.sum(a * b).alias(f"_x{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    sums += [F.sum(c * F.col(y)).alias(f"_y{i}") for i, c in enumerate(cols)]
    g = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums)
    xx = F.array(*[F.col(f"_x{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return g.select(*by, "n", xx.alias("xx"), F.array(*[F.col(f"_y{i}") for i in range(k)]).alias("xy"), "yy")


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, const, one coefficient each regressor, sigma2 = RSS / (n - k - 1), r2, n. Groups that
    have fewer rows than coefficients, or singular regressors, get NULL coefficients."""
    g = gram(df, y, xs, by)
    names = ["const", *[f"b_{x}" for x in xs]]
    k = len(names)
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"{c} double" for c in names] + ["sigma2 double", "r2 double", "n long"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for xx, xy, yy, n in zip(pdf["xx"], pdf["xy"], pdf["yy"], pdf["n"], strict=True):
                a, c = np.array(xx, float).reshape(k, k), np.array(xy, float)
                scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
                scaled = a * np.outer(scale, scale)
                if n < k or np.linalg.cond(scaled) > 1e12:
                    rows.append([None] * (k + 2) + [n])
                    continue
                b = np.linalg.solve(scaled, c * scale) * scale
                rss, tss = float(yy - b @ c), float(yy - c[0] ** 2 / n)
                rows.append([*b, rss / (n - k) if n > k else None, 1 - rss / tss if tss > 0 else None, n])
            out = pd.DataFrame(rows, columns=[*names, "sigma2", "r2", "n"])
            yield pd.concat([pdf[list(by)].reset_index(drop=True), out], axis=1)

    return g.mapInPandas(solve, schema)


def one_factor(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """const, beta, r2 and residual variance of one regressor, by the built-in aggregates."""
    n = F.regr_count(y, x)
    rss = F.regr_syy(y, x) - ratio(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))
    return df.groupBy(*by).agg(F.regr_intercept(y, x).alias("const"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), ratio(rss, n - 2).alias("sigma2"))


def hac_mean(df: DataFrame, x: str, time: str, lags: int | None = None) -> DataFrame:
    """mean, se and t of one series with Bartlett weights; lags default to round(T ** 1/4).

    Lagged products come from a join on the row number, one row a date and lag."""
    w = Window.orderBy(time)  # one series
    rows = df.where(F.col(x).isNotNull()).select(F.row_number().over(w).alias("k"), F.col(x).alias("x"))
    stats = rows.agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("t"))
    stats = stats.withColumn("lags", F.lit(lags) if lags is not None else F.round(F.pow("t", 0.25)).cast("int"))
    u = rows.join(F.broadcast(stats)).withColumn("u", F.col("x") - F.col("mean"))
    ahead = u.select("u", "t", "mean", "lags", F.posexplode(F.sequence(F.lit(0), F.col("lags"))).alias("_p", "l"), "k")
    pairs = ahead.join(u.select(F.col("k").alias("k2"), F.col("u").alias("v")), F.col("k2") == F.col("k") - F.col("l"))
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("lags") + 1)))
    total = pairs.groupBy("mean", "t").agg((F.sum(F.col("u") * F.col("v") * weight)).alias("s"))
    return total.select("mean", (F.sqrt("s") / F.col("t")).alias("se"), (F.col("mean") / (F.sqrt("s") / F.col("t"))).alias("tstat"))


def hac_ols(df: DataFrame, y: str, xs: Sequence[str], time: str, by: str, lags: int | None = None) -> DataFrame:
    """by, term, coef, se, t: least squares with Newey-West errors of each group's series."""
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(time)
        if len(pdf) <= len(xs) + 1:
            return pd.DataFrame({by: [], "term": [], "coef": [], "se": [], "tstat": []}, dtype=object)
        x = np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(float)])
        b = K.ols(x, pdf[[y]].to_numpy(float))[:, 0]
        n = round(len(pdf) ** 0.25) if lags is None else lags
        se = np.sqrt(np.diag(K.newey_west(x, pdf[y].to_numpy(float) - x @ b, n)))
        return pd.DataFrame({by: pdf[by].iloc[0], "term": ["const", *xs], "coef": b, "se": se, "tstat": b / se})

    return df.select(by, time, y, *xs).groupBy(by).applyInPandas(fit, f"{by} {kinds[by]}, term string, coef double, se double, tstat double")


def stars(t: Column) -> Column:
    """Marks of significance of a t statistic at 10, 5 and 1 percent."""
    a = F.abs(t)
    return F.when(a > 2.58, "***").when(a > 1.96, "**").when(a > 1.645, "*").otherwise("")


def within(df: DataFrame, columns: Sequence[str], entity: str | None, time: str | None) -> DataFrame:
    """Columns less their entity or time means; for both, the two-way transform, which is exact on
    balanced panels: any other is an error."""
    out = df
    if entity and time:
        n, entities, times = df.agg(F.count(F.lit(1)), F.count_distinct(entity), F.count_distinct(time)).first()
        if n != entities * times:
            raise ValueError(f"two-way effects need a balanced panel: {n} rows of {entities} x {times}")
        out = df.join(F.broadcast(df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])))  # one row
    for c in columns:
        own: Column = F.col(c)
        if entity:
            own = own - F.avg(c).over(Window.partitionBy(entity))
        if time:
            own = own - F.avg(c).over(Window.partitionBy(time))
        if entity and time:
            own = own + F.col(f"_mean_{c}")
        out = out.withColumn(f"_{c}", own)
    return out


def panel_ols(df: DataFrame, y: str, x: str, effects: str = "none", lag: int = 0, entity: str = "permno", time: str = "date") -> DataFrame:
    """beta, n of one regressor with fixed effects none, entity or time; x lagged by rows if asked.
    Two-way effects need a balanced panel."""
    if effects not in ("none", "entity", "time", "both"):
        raise ValueError(f"unknown effects {effects!r}")
    if lag:
        df = df.withColumn(x, F.lag(x, lag).over(Window.partitionBy(entity).orderBy(time)))
    full = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    if effects == "none":
        return full.agg(F.regr_slope(y, x).alias("beta"), F.regr_count(y, x).alias("n"))
    own = within(full, [y, x], entity if effects in ("entity", "both") else None, time if effects in ("time", "both") else None)
    return own.agg(ratio(F.sum(F.col(f"_{x}") * F.col(f"_{y}")), F.sum(F.col(f"_{x}") * F.col(f"_{x}"))).alias("beta"), F.count(F.lit(1)).alias("n"))


def panel_errors(df: DataFrame, y: str, x: str, effects: str = "entity", lag: int = 0, lags: int = 3, entity: str = "permno", time: str = "date") -> DataFrame:
    """beta, se, tstat, n of panel_ols() with one kind of effects (none, entity or time) and errors robust
    to correlation over entities and, with Bartlett weights, over ``lags`` dates: the scores are added
    up by date, and the kernel works on that one row a date."""
    if effects not in ("none", "entity", "time"):
        raise ValueError(f"unknown effects {effects!r}")
    if lag:
        df = df.withColumn(x, F.lag(x, lag).over(Window.partitionBy(entity).orderBy(time)))
    full = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    if effects == "none":
        means = full.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))  # one row
        own = full.join(F.broadcast(means)).withColumn(f"_{x}", F.col(x) - F.col("_mx")).withColumn(f"_{y}", F.col(y) - F.col("_my"))
    else:
        own = within(full, [y, x], entity if effects == "entity" else None, time if effects == "time" else None)
    own = own.select(F.col(time).alias("_t"), F.col(f"_{x}").alias("_u"), F.col(f"_{y}").alias("_v"))
    by_date = own.groupBy("_t").agg(F.sum(F.col("_u") * F.col("_v")).alias("uv"), F.sum(F.col("_u") * F.col("_u")).alias("uu"), F.count(F.lit(1)).alias("n"))
    total = by_date.agg(F.sum("uv").alias("suv"), F.sum("uu").alias("suu"), F.sum("n").alias("sn"))  # one row
    w = Window.orderBy("_t")  # one row a date
    scores = by_date.join(F.broadcast(total)).withColumn("h", F.col("uv") - F.col("suv") / F.col("suu") * F.col("uu"))
    parts = [F.col("h") * F.col("h"), *[F.lit(2 * (1 - k / (lags + 1))) * F.col("h") * F.coalesce(F.lag("h", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)]]
    summed = scores.withColumn("s", sum(parts[1:], parts[0])).agg(F.sum("s").alias("s"), F.first("suv").alias("suv"), F.first("suu").alias("suu"), F.first("sn").alias("n"))
    beta, se = ratio(F.col("suv"), F.col("suu")), F.sqrt(F.when(F.col("s") > 0, F.col("s"))) / F.col("suu")
    return summed.select(beta.alias("beta"), se.alias("se"), ratio(beta, se).alias("tstat"), "n")
