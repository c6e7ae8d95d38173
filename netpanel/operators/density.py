"""Density curves: Gaussian kernel estimates from linearly binned values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed(df: DataFrame, value: str, by: Sequence[str], tails: float) -> DataFrame:
    """by and value of the rows strictly between the tails/2 and 1 - tails/2 quantiles of their group."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias(value))
    if not tails:
        return known
    q = known.groupBy(*by).agg(F.percentile(value, F.lit(tails / 2)).alias("_low"), F.percentile(value, F.lit(1 - tails / 2)).alias("_high"))
    return known.join(q, list(by)).where(f"round({value}, 10) > round(_low, 10) and round({value}, 10) < round(_high, 10)").drop("_low", "_high")


def density(df: DataFrame, value: str, by: Sequence[str], points: int = 100, cells: int = 1000, tails: float = 0.0) -> DataFrame:
    """by, point, x, density, scaled, gaussian: at points from 5 % of the range below the least value to 5 % above the
    largest, the kernel estimate with Scott's bandwidth, the same in counts of a histogram of so many bins,
    and the normal density of the values' mean and deviation.

    A value is shared out between the two nearest of cells + 1 places over the range in proportion to its nearness;
    the sums by place, not the values, meet the points. Groups of one value or none have no curve; rows
    without a group or value are left out, and so are ``tails`` of each group, half on either side."""
    by = list(by)
    own = trimmed(df.dropna(subset=by), value, by, tails)
    stats = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_hi > _lo")
    at = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells
    placed = own.join(stats.select(*by, "_lo", "_hi"), by).select(*by, F.floor(at).alias("_k"), (at - F.floor(at)).alias("_f"))
    shares = F.explode(F.array(F.struct(F.col("_k").alias("k"), (1 - F.col("_f")).alias("w")), F.struct((F.col("_k") + 1).alias("k"), F.col("_f").alias("w"))))
    bins = placed.select(*by, shares.alias("_s")).groupBy(*by, F.col("_s.k").alias("_k")).agg(F.sum("_s.w").alias("_w"))
    span, h = F.col("_hi") - F.col("_lo"), F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("_lo") + span * (F.col("point") * (1.1 / (points - 1)) - 0.05))
    u = (F.col("x") - F.col("_lo") - span * F.col("_k") / cells) / h
    curve = grid.join(bins, by).groupBy(*by, "point", "x", "_n", "_mean", "_std", "_lo", "_hi").agg((F.sum(F.col("_w") * F.exp(-u * u / 2)) / F.col("_n") / h / math.sqrt(2 * math.pi)).alias("density"))
    z = (F.col("x") - F.col("_mean")) / F.col("_std")
    return curve.select(*by, "point", "x", "density", (F.col("density") * span / points * F.col("_n") * (1 - tails)).alias("scaled"), (F.exp(-z * z / 2) / F.col("_std") / math.sqrt(2 * math.pi)).alias("gaussian"))
