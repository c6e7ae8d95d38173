"""Lagged moments of windows of a panel, added up by Spark; tasks solve the small systems they give.

A window (key) of a long panel (key, date, permno >= 0, x, factors) is reduced to the dates on which
all its series have a value, and its series are centred (and scaled, if asked) over these dates. For
each fold of the dates, lag k and pair of blocks of BLOCK series, C_k = sum of x(t) x(t - k)' over the
fold's dates. Beside the series stand a constant (id CONST) and the factors (ids below it). Gram
matrices of models with several lags are block-Toeplitz but for the ends of a fold: the block
of lags a <= b is C_(b-a) and a few products of the p dates before the fold's start and end, which
come as rows of their own. So each pair of series is multiplied p + 1 times, not p * p times, and the
fitted models never see a row of the panel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series of a block, dates of a chunk; the id of the constant.
BLOCK, CHUNK = 64, 512
CONST = -1
MOMENTS = "fold int, kind string, lag int, i array<bigint>, j array<bigint>, v array<double>"


def on_complete_days(df: DataFrame, key: str, factors: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, dates, permno, x: the series, and the factors under ids below CONST, of each window on
    the dates (pos, from 0; dates is their number) on which no series misses."""
    own = Window.partitionBy(key)
    n = df.groupBy(key).agg(F.count_distinct("permno").alias("_n"))
    days = df.groupBy(key, "date").agg(F.count("x").alias("_c"), *[F.first(f, ignorenulls=True).alias(f) for f in factors])
    days = days.join(n, key).where(F.col("_c") == F.col("_n"))
    days = days.withColumn("pos", F.row_number().over(own.orderBy("date")) - 1).withColumn("dates", F.count(F.lit(1)).over(own))
    series = df.select(key, "date", F.col("permno").cast("long").alias("permno"), F.col("x").cast("double").alias("x")).join(days.select(key, "date", "pos", "dates"), [key, "date"])
    out = series.select(key, "pos", "dates", "permno", "x")
    for at, f in enumerate(factors):
        out = out.unionByName(days.select(key, "pos", "dates", F.lit(CONST - 1 - at).cast("long").alias("permno"), F.col(f).cast("double").alias("x")))
    return out


def centred(rows: DataFrame, key: str, scale: bool = False) -> DataFrame:
    """key, pos, dates, blocks, block, permno, z, mean, std of rows (key, pos, dates, permno, x) with a
    value of each series at each pos, and of the constant: z is centred, and divided by std if ``scale``."""
    each = Window.partitionBy(key, "permno")
    std = F.stddev_samp("x").over(each)
    size = F.ceil((F.count(F.lit(1)).over(Window.partitionBy(key, "pos")) + 1) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", size).withColumn("mean", F.avg("x").over(each)).withColumn("std", F.when(std > 0, std).otherwise(1.0))
    z = (F.col("x") - F.col("mean")) / (F.col("std") if scale else F.lit(1.0))
    ones = rows.groupBy(key, "pos").agg(F.first("dates").alias("dates"), F.first("blocks").alias("blocks"))
    ones = ones.select(key, "pos", "dates", "blocks", F.lit(CONST).cast("long").alias("permno"), F.lit(1.0).alias("z"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
    out = rows.select(key, "pos", "dates", "blocks", "permno", z.alias("z"), "mean", "std").unionByName(ones)
    return out.withColumn("block", F.pmod(F.xxhash64("permno"), "blocks").cast("int"))


def complete(df: DataFrame, key: str, factors: tuple[str, ...] = (), scale: bool = False) -> DataFrame:
    return centred(on_complete_days(df, key, factors), key, scale)


def fold_of(row: Column, rows: Column, folds: int) -> Column:
    """The label of a row among contiguous folds, labelled folds - 1 ... 0; the remaining rows go to
    the folds of least label."""
    if folds == 1:
        return F.lit(0)
    length, rest = F.floor(rows / folds), rows % folds
    short = (folds - rest) * length
    label = F.when(row < short, folds - 1 - F.floor(row / F.greatest(length, F.lit(1)))).otherwise(rest - 1 - F.floor((row - short) / (length + 1)))
    return label.cast("int")


def shuffle_free_fold(row: Column, rows: Column, folds: int) -> Column:
    """The label of a row among contiguous folds 0 ... folds - 1, the first ones longer by one."""
    k = F.least(F.lit(folds), rows)
    length, rest = F.floor(rows / k), rows % k
    long = rest * (length + 1)
    return F.when(row < long, F.floor(row / (length + 1))).otherwise(rest + F.floor((row - long) / length)).cast("int")


def moments(rows: DataFrame, key: str, lags: int = 1, folds: int = 1, label: Callable[[Column, Column, int], Column] = fold_of) -> DataFrame:
    """key and MOMENTS of centred(): kind c, the sums C_lag of i's values with j's ``lag`` dates before (a
    row for each chunk and pair of blocks); kinds s and e, the values of series i ``lag`` dates before the fold's
    start and end; kind m, means and standard deviations of the series i."""
    kind = dict(rows.dtypes)[key]
    rows = rows.where(F.col("dates") > lags)  # a shorter window has no row to fit
    over = Window.partitionBy(key, "permno").orderBy("pos")
    count, row = F.col("dates") - lags, F.col("pos") - lags
    fold = label(row, count, folds)
    begins = (row == 0) | (fold != label(row - 1, count, folds))
    stops = (row == count - 1) | (fold != label(row + 1, count, folds))
    back = rows.select("*", *[F.lag("z", k).over(over).alias(f"z{k}") for k in range(1, lags + 1)]).where(row >= 0)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
    placed = back.select(
        key, fold.alias("fold"), F.floor(F.col("pos") / CHUNK).cast("int").alias("chunk"), "pos", "permno", "block", begins.alias("begins"), stops.alias("stops"), "mean", "std",
        F.col("z").alias("z0"), *[f"z{k}" for k in range(1, lags + 1)], other,
    )
    placed = placed.withColumn("bi", F.least("block", "_o")).withColumn("bj", F.greatest("block", "_o")).drop("_o")
    schema = f"{key} {kind}, {MOMENTS}"

    def products(table: pa.Table) -> pa.Table:
        ids, pos, block = (table.column(c).to_numpy() for c in ("permno", "pos", "block"))
        names, at = np.unique(ids, return_inverse=True)
        days, day = np.unique(pos, return_inverse=True)
        zs = []
        for k in range(lags + 1):
            m = np.zeros((len(days), len(names)))
            m[day, at] = table.column(f"z{k}").to_numpy()
            zs.append(m)
        of = np.zeros(len(names), int)
        of[at] = block
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        sides = [(of == bi, of == bj)] + ([(of == bj, of == bi)] if bi != bj else [])
        out = [("c", k, names[a], names[b], (zs[0][:, a].T @ zs[k][:, b]).ravel()) for a, b in sides for k in range(lags + 1)]
        if bi == bj:
            none = np.empty(0, np.int64)
            if days[0] == lags:
                level = np.zeros((2, len(names)))
                for r, c in enumerate(("mean", "std")):
                    level[r, at] = table.column(c).to_numpy()
                out.append(("m", 0, names, none, level.ravel()))
            first, last = day[table.column("begins").to_numpy()], day[table.column("stops").to_numpy()]
            out += [("s", o, names, none, zs[o][first[0]]) for o in range(1, lags + 1) if len(first)]
            out += [("e", o, names, none, zs[o - 1][last[0]]) for o in range(1, lags + 1) if len(last)]
        n = len(out)
        columns = {key: table.column(key).slice(0, 1).to_pylist() * n, "fold": [table.column("fold")[0].as_py()] * n} | {c: [o[k] for o in out] for k, c in enumerate(("kind", "lag", "i", "j", "v"))}
        kinds = {key: table.schema.field(key).type, "fold": pa.int32(), "kind": pa.string(), "lag": pa.int32(), "i": pa.list_(pa.int64()), "j": pa.list_(pa.int64()), "v": pa.list_(pa.float64())}
        return pa.table({c: pa.array(v, type=kinds[c]) for c, v in columns.items()})

    return placed.groupBy(key, "fold", "chunk", "bi", "bj").applyInArrow(products, schema)


class System:
    """The moments of one window, put together: for each fold (sorted) its number of dates n, xx of the
    regressors (the constant, if asked, the factors, then lags 1 ... p of all series), xy and yy."""

    def __init__(self, pdf: pd.DataFrame, lags: int, constant: bool) -> None:
        whole = pdf[pdf["kind"] == "m"]
        ids = np.concatenate(list(whole["i"]))
        level = np.hstack([np.array(v).reshape(2, -1) for v in whole["v"]])[:, np.argsort(ids)]
        ids = np.sort(ids)
        self.names = ids[ids >= 0]
        self.factors = -np.sort(-ids[ids < CONST])
        self.mean, self.std = level[:, ids >= 0]
        self.factor_mean, self.factor_std = (level[:, np.searchsorted(ids, self.factors)] if len(self.factors) else np.zeros((2, 0)))
        self.lags, self.constant, n = lags, constant, len(ids)
        self.folds = sorted(pdf["fold"].unique())
        index = {f: k for k, f in enumerate(self.folds)}
        self._c = np.zeros((len(self.folds), lags + 1, n, n))
        edges: dict[tuple[str, int, int], np.ndarray] = {}
        for fold, kind, lag, i, j, v in zip(pdf["fold"], pdf["kind"], pdf["lag"], pdf["i"], pdf["j"], pdf["v"], strict=True):
            if kind == "c":
                self._c[index[fold], lag][np.ix_(np.searchsorted(ids, i), np.searchsorted(ids, j))] += np.array(v).reshape(len(i), len(j))
            elif kind in "se":
                edge = edges.setdefault((kind, index[fold], lag), np.zeros(n))
                edge[np.searchsorted(ids, i)] = v
        self._edges = {k: v[ids >= 0] for k, v in edges.items()}
        self._own, self._one = np.flatnonzero(ids >= 0), int(np.searchsorted(ids, CONST))
        self._fixed = [*([self._one] if constant else []), *np.searchsorted(ids, self.factors).tolist()]
        self.n = np.array([c[0, self._one, self._one] for c in self._c])
        self.yy = np.stack([c[0][np.ix_(self._own, self._own)] for c in self._c])
        self.xy = np.stack([self._cross(c) for c in self._c])
        self.xx = np.stack([self._gram(k, c) for k, c in enumerate(self._c)])

    def _cross(self, c: np.ndarray) -> np.ndarray:
        return np.vstack([c[0][np.ix_(self._fixed, self._own)], *[c[b][np.ix_(self._own, self._own)].T for b in range(1, self.lags + 1)]])

    def _gram(self, k: int, c: np.ndarray) -> np.ndarray:
        own, fixed, m = self._own, self._fixed, len(self._own)
        out = np.zeros((len(fixed) + self.lags * m,) * 2)
        at = lambda a: slice(len(fixed) + (a - 1) * m, len(fixed) + a * m)
        out[: len(fixed), : len(fixed)] = c[0][np.ix_(fixed, fixed)]
        for a in range(1, self.lags + 1):
            out[: len(fixed), at(a)] = c[a][np.ix_(fixed, own)]
            out[at(a), : len(fixed)] = out[: len(fixed), at(a)].T
            for b in range(a, self.lags + 1):
                block = c[b - a][np.ix_(own, own)].copy()
                for o in range(1, a + 1):  # the dates before the start come in, those before the end go
                    block += np.outer(self._edges["s", k, o], self._edges["s", k, o + b - a])
                    block -= np.outer(self._edges["e", k, o], self._edges["e", k, o + b - a])
                out[at(a), at(b)] = block
                out[at(b), at(a)] = block.T
        return out

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each fold's rows of the regressors (without a constant) and of the responses."""
        x = [np.concatenate([c[0][self._one, self._fixed[int(self.constant) :]], *[c[b][self._one, self._own] for b in range(1, self.lags + 1)]]) for c in self._c]
        return np.stack(x), np.stack([c[0][self._one, self._own] for c in self._c])

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        return self.xx.sum(axis=0), self.xy.sum(axis=0), self.yy.sum(axis=0), float(self.n.sum())

    def least_squares(self) -> np.ndarray:
        """Coefficients (regressors x equations) on the centred data; the least-norm solution where the regressors are singular."""
        xx, xy, _, _ = self.total()
        scale = 1 / np.sqrt(np.maximum(np.diag(xx), 1e-300))
        return np.linalg.lstsq(xx * np.outer(scale, scale), xy * scale[:, None], rcond=1e-13)[0] * scale[:, None]

    def own_units(self, b: np.ndarray, scaled: bool) -> np.ndarray:
        """Coefficients of the data itself from those of centred (and scaled) data: the constant first."""
        k = int(self.constant)
        shift = b[0] if self.constant else np.zeros(b.shape[1])
        load, own = b[k : k + len(self.factors)], b[k + len(self.factors) :]
        if scaled:
            shift = shift * self.std
            load = load * self.std[None, :] / self.factor_std[:, None]
            own = own * self.std[None, :] / np.tile(self.std, self.lags)[:, None]
        const = self.mean + shift - self.factor_mean @ load - np.tile(self.mean, self.lags) @ own
        return np.vstack([const, load, own])

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Means of xx and xy over the rows outside each fold."""
        n = (self.n.sum() - self.n)[:, None, None]
        return (self.xx.sum(axis=0) - self.xx) / n, (self.xy.sum(axis=0) - self.xy) / n

    def response_std(self) -> float:
        """Standard deviation of all values of the responses together."""
        size = self.n.sum() * self.yy.shape[1]
        total = sum(float(c[0][self._one, self._own].sum()) for c in self._c)
        return float(np.sqrt(max(np.trace(self.yy.sum(axis=0)) / size - (total / size) ** 2, 0.0)))

    def losses(self, coefs: np.ndarray) -> list[float]:
        """Mean squared errors of each fold's rows under that fold's coefficients (folds x regressors x equations)."""
        m = self.yy.shape[1]
        out = []
        for xx, xy, yy, n, b in zip(self.xx, self.xy, self.yy, self.n, coefs, strict=True):
            out.append(max(float(np.trace(yy) - 2 * (b * xy).sum() + (b * (xx @ b)).sum()), 0.0) / (n * m))
        return out


def solved(found: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """fn(moments of one window) with its key, and the columns ``by`` that split its work, put in front."""
    kinds = dict(found.dtypes)
    front = ", ".join(f"{c} {kinds[c]}" for c in (key, *by))
    names = [c.split()[0] for c in f"{front}, {schema}".split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        if out is None or not len(out):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        for at, c in enumerate((key, *by)):
            out.insert(at, c, pdf[c].iloc[0])
        return out

    return found.groupBy(key, *by).applyInPandas(run, f"{front}, {schema}")
