"""Correlation networks from signs: the stacked regression of sign(x_i x_j), x centred, on one dummy for each
ordered pair of series. The design is orthogonal, so the elastic net of the stacked problem is a soft threshold of
the pair's mean sign, and the whole search works on counts by pair and fold: all in Spark's aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moments as MO


def sign_sums(df: DataFrame, key: str, folds: int = 1, least: int = 1) -> DataFrame:
    """key, series, i, j, fold, n, s, q: for i <= j and each contiguous fold of the dates on which no series of the window
    misses, their number and the sums of the sign of x_i x_j and of its square; windows of under ``least`` dates give none."""
    rows = MO.on_complete_days(df, key).where(F.col("dates") >= least)
    own = F.col("x") - F.avg("x").over(Window.partitionBy(key, "permno"))
    series = F.count(F.lit(1)).over(Window.partitionBy(key, "pos"))
    # a value at its mean, but for rounding, has no sign
    one = rows.select(key, "pos", F.col("permno").alias("i"), F.signum(F.round(own, 10)).alias("a"), series.alias("series"), MO.shuffle_free_fold(F.col("pos"), F.col("dates"), folds).alias("fold"))
    other = one.select(key, "pos", F.col("i").alias("j"), F.col("a").alias("b"))
    sign = F.col("a") * F.col("b")
    return one.join(other, [key, "pos"]).where("i <= j").groupBy(key, "series", "i", "j", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(sign).alias("s"), F.sum(sign * sign).alias("q"))


def threshold(mean: Column, series: Column, alpha: Column, lambdau: Column) -> Column:
    """The pair's coefficient: a penalty of the stacked problem counts once for each of its series**2 dummies."""
    level = lambdau * series * series
    return F.signum(mean) * F.greatest(F.abs(mean) - level * alpha, F.lit(0.0)) / (1 + level * (1 - alpha))


def losses(sums: DataFrame, key: str, points: Sequence[tuple[float, float]]) -> DataFrame:
    """key, alpha, lambdau, loss of each point (alpha, lambdau): the mean over folds of the mean squared error of
    the fold's signs, all ordered pairs, under the net of the other folds."""
    own = Window.partitionBy(key, "i", "j")
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(u)).alias("lambdau")) for a, u in points]))
    rest = sums.select("*", (F.sum("s").over(own) - F.col("s")).alias("rs"), (F.sum("n").over(own) - F.col("n")).alias("rn")).where("rn > 0")
    tried = rest.select("*", grid.alias("p"))
    b = threshold(F.col("rs") / F.col("rn"), F.col("series"), F.col("p.alpha"), F.col("p.lambdau"))
    twice = F.when(F.col("i") < F.col("j"), 2).otherwise(1)
    fold = tried.withColumn("b", b).groupBy(key, "p.alpha", "p.lambdau", "fold").agg((F.sum(twice * (F.col("q") - 2 * F.col("b") * F.col("s") + F.col("n") * F.col("b") * F.col("b"))) / F.sum(twice * F.col("n"))).alias("loss"))
    return fold.groupBy(key, "alpha", "lambdau").agg(F.avg("loss").alias("loss"))


def best(found: DataFrame, key: str) -> DataFrame:
    """The point of least loss; of equal ones (to nine decimals) the larger penalty, then the larger alpha."""
    order = Window.partitionBy(key).orderBy(F.round("loss", 9), F.desc("lambdau"), F.desc("alpha"))
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def net(sums: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """key, i, j, v for i <= j: the nets of all folds together at each window's point (key, alpha, lambdau)."""
    whole = sums.groupBy(key, "series", "i", "j").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(points, key).select(key, "i", "j", threshold(F.col("mean"), F.col("series"), F.col("alpha"), F.col("lambdau")).alias("v"))


def search(df: DataFrame, key: str, points: Sequence[tuple[float, float]], folds: int = 12) -> DataFrame:
    """key, i, j, v, alpha, lambdau: each window's net at its best point; windows of under two dates a fold give none."""
    sums = sign_sums(df, key, folds, 2 * folds)
    found = best(losses(sums, key, points), key)
    return net(sums, found, key).join(found.select(key, "alpha", "lambdau"), key)
