"""Matrices as edge lists (i, j, v), grouped by a window key where there is one, and network
measures on them: row i receives from column j."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import ratio


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def identity(a: DataFrame) -> DataFrame:
    return a.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def add(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("i", "j", "v")
    for p in parts[1:]:
        out = out.unionByName(p.select("i", "j", "v"))
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def vma(a: DataFrame, horizon: int) -> list[DataFrame]:
    """Moving-average matrices 0 ... horizon of a first-order model."""
    out = [identity(a)]
    for _ in range(horizon):
        out.append(matmul(a, out[-1]))
    return out


def irv(a: DataFrame, cov: DataFrame, horizon: int) -> DataFrame:
    return matmul(add(*vma(a, horizon - 1)), cov)


def mse(a: DataFrame, cov: DataFrame, horizon: int) -> DataFrame:
    parts = [matmul(matmul(p, cov), transpose(p)).where("i = j") for p in vma(a, horizon)]
    return add(*parts).select("i", F.col("v").alias("mse"))


def connectedness(edges: DataFrame, by: Sequence[str] = (), others_only: bool = True) -> DataFrame:
    """node, n_in, n_out, n_self, n_total, n_net: received, sent, own, and their sum and balance."""
    v = F.when(F.col("i") != F.col("j"), F.col("v")) if others_only else F.col("v")
    got = edges.groupBy(*by, F.col("i").alias("node")).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("n_in"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("n_self"))
    sent = edges.groupBy(*by, F.col("j").alias("node")).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("n_out"))
    total = F.col("n_in") + F.col("n_out") - (F.lit(0.0) if others_only else F.coalesce("n_self", F.lit(0.0)))
    return got.join(sent, [*by, "node"]).withColumn("n_total", total).withColumn("n_net", F.col("n_out") - F.col("n_in"))


def concentration(edges: DataFrame, by: Sequence[str] = (), side: str = "in", measure: str = "herfindahl_index", others_only: bool = True) -> DataFrame:
    """node, value: concentration of each row's (in) or true column's (out) shares."""
    node = "i" if side == "in" else "j"
    rows = edges.where("i <> j") if others_only else edges
    rows = rows.withColumn("_p", ratio(F.col("v"), F.sum("v").over(Window.partitionBy(*by, node))))
    w = Window.partitionBy(*by, node)
    if measure == "herfindahl_index":
        value: Column = F.sum(F.col("_p") * F.col("_p"))
    elif measure == "entropy":
        value = ratio(-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p"))), F.ln(F.count(F.lit(1))))
    elif measure == "power_law_exponent":
        rows = rows.withColumn("_q", F.when(F.col("_p") > 0, F.col("_p"))).withColumn("_l", F.ln(F.col("_q") / F.min("_q").over(w)))
        value = ratio(F.lit(1.0), 1 + ratio(F.count("_l"), F.sum("_l")))
    else:
        raise ValueError("measure must be herfindahl_index, entropy or power_law_exponent")
    return rows.groupBy(*by, F.col(node).alias("node")).agg(value.alias("value"))


def asymmetry(edges: DataFrame, by: Sequence[str] = (), drop_diagonal: bool = False) -> DataFrame:
    e = edges.where("i <> j") if drop_diagonal else edges
    swapped = e.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    both = e.join(swapped, [*by, "i", "j"], "full_outer").select(*by, F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"))
    return both.groupBy(*by).agg(ratio(F.sum(F.abs((F.col("v") - F.col("w")) / 2)), F.sum(F.abs("v"))).alias("asymmetry"))


def shrinkage(a: DataFrame, benchmark: DataFrame, drop_zeros: bool = False) -> DataFrame:
    both = a.join(benchmark.withColumnRenamed("v", "w"), ["i", "j"])
    if drop_zeros:
        both = both.where("v <> 0")
    return both.agg((1 - ratio(F.avg(F.abs("v")), F.avg(F.abs("w")))).alias("shrinkage"))


def scaled_by_diagonal(m: DataFrame, sign: float = 1.0) -> DataFrame:
    """v / sqrt(v_ii v_jj): correlations of a covariance; with sign -1 the partial correlations of a precision."""
    d = m.where("i = j").select(F.col("i").alias("_d"), F.col("v").alias("_v"))
    joined = m.join(F.broadcast(d.withColumnsRenamed({"_d": "i", "_v": "_vi"})), "i").join(F.broadcast(d.withColumnsRenamed({"_d": "j", "_v": "_vj"})), "j")
    value = F.col("v") / F.sqrt(F.col("_vi") * F.col("_vj"))
    return joined.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(sign * value).alias("v"))


def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(labels, matrix) of one window's edges; absent edges are 0."""
    labels = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
    m = np.zeros((len(labels), len(labels)))
    m[np.searchsorted(labels, pdf["i"]), np.searchsorted(labels, pdf["j"])] = pdf["v"]
    return labels, m


def edge_rows(labels: np.ndarray, m: np.ndarray, **keys: object) -> pd.DataFrame:
    n = len(labels)
    return pd.DataFrame(keys | {"i": np.repeat(labels, n), "j": np.tile(labels, n), "v": m.ravel()})


def by_window(edges: DataFrame, key: str, fn: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """fn(labels, matrix) of each window's matrix; key is put before its columns."""
    kind = dict(edges.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(*dense(pdf))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return edges.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def eigenvector_centrality(edges: DataFrame, key: str) -> DataFrame:
    return by_window(edges, key, lambda n, m: pd.DataFrame({"node": n, "n_in": K.dominant(m), "n_out": K.dominant(m.T)}), "node long, n_in double, n_out double")


def page_rank(edges: DataFrame, key: str, alpha: float = 0.85) -> DataFrame:
    return by_window(edges, key, lambda n, m: pd.DataFrame({"node": n, "n_in": K.page_rank(m, alpha), "n_out": K.page_rank(m, alpha, outgoing=True)}), "node long, n_in double, n_out double")


def leontief(edges: DataFrame, key: str) -> DataFrame:
    return by_window(edges, key, lambda n, m: edge_rows(n, K.leontief(m)), "i long, j long, v double")
