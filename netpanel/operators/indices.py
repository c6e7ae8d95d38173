"""Index weights, portfolio returns and sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.windows import average_rank, quantile_bucket, share


def long_weights(df: DataFrame, variable: str = "equal", date: str = "date") -> DataFrame:
    """Adds weight: 1 / count, or the variable's share of its date's sum; infinite becomes NULL."""
    w = Window.partitionBy(date)
    weight = 1 / F.count(F.lit(1)).over(w) if variable == "equal" else share(F.col(variable), w)
    return df.withColumn("weight", weight)


def residual_weights(df: DataFrame, variable: str, benchmark: str = "equal", leverage: float | None = None, date: str = "date") -> DataFrame:
    """Adds weight: the variable's weights less the benchmark's; with a leverage, scaled so that
    absolute weights sum to it on each date."""
    w = Window.partitionBy(date)
    bench = 1 / F.count(F.lit(1)).over(w) if benchmark == "equal" else share(F.col(benchmark), w)
    out = df.withColumn("weight", share(F.col(variable), w) - bench)
    if leverage is not None:
        out = out.withColumn("weight", ratio(F.lit(leverage) * F.col("weight"), F.sum(F.abs("weight")).over(w)))
    return out


def excess_returns(df: DataFrame, rates: DataFrame, ret: str = "ret") -> DataFrame:
    return df.join(rates.select("date", "rf"), "date", "left").withColumn(ret, F.col(ret) - F.col("rf")).drop("rf")


def leg(df: DataFrame, which: str, weight: str = "weight") -> DataFrame:
    if which == "both":
        return df
    if which == "long":
        return df.where(F.col(weight) > 0)
    if which == "short":
        return df.where(F.col(weight) < 0)
    raise ValueError(f"leg must be both, long or short, not {which!r}")


def index_portfolio(weights: DataFrame, returns: DataFrame, which: str = "both", keys: Sequence[str] = ("sampling_date", "permno"), date: str = "date") -> DataFrame:
    """Return of each date: sum of return times weight. Missing returns are 0, rows without a
    weight are absent."""
    held = leg(weights.where(F.col("weight").isNotNull()), which).select(*keys, "weight")
    joined = returns.withColumn("ret", F.coalesce("ret", F.lit(0.0))).join(held, list(keys))
    return joined.groupBy(date).agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def hedged(long: DataFrame, short: DataFrame, factor: DataFrame) -> DataFrame:
    """date, ret: the short leg plus the long leg scaled so that their full-sample betas cancel."""
    both = long.withColumnRenamed("ret", "l").join(short.withColumnRenamed("ret", "s"), "date").join(factor, "date")
    betas = both.agg(F.regr_slope("l", "factor").alias("bl"), F.regr_slope("s", "factor").alias("bs"))  # one row
    return both.join(F.broadcast(betas)).select("date", (F.col("s") - F.col("l") * ratio(F.col("bs"), F.col("bl"))).alias("ret"))


def ranked_asset_returns(df: DataFrame, by: str, ret: str, ranks: Sequence[int]) -> DataFrame:
    """date and the return of the k-th ranked asset, one column a rank."""
    w = Window.partitionBy("date").orderBy(F.col(by).desc_nulls_last(), "permno")
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k").isin(list(ranks)))
    return ranked.groupBy("date").agg(*[F.max(F.when(F.col("_k") == k, F.col(ret))).alias(f"shock_{k}") for k in ranks])


def sorted_means(df: DataFrame, by: str, value: str, q: int = 5, date: str = "date") -> DataFrame:
    """date, bucket and the mean of value in each quantile bucket."""
    return quantile_bucket(df.where(F.col(by).isNotNull()), by, q, [date]).groupBy(date, "bucket").agg(F.avg(value).alias(value))


def high_minus_low(means: DataFrame, value: str, q: int = 5, date: str = "date") -> DataFrame:
    at = lambda k: F.max(F.when(F.col("bucket") == k, F.col(value)))
    return means.groupBy(date).agg(at(1).alias("low"), at(q).alias("high")).withColumn("hml", F.col("high") - F.col("low"))


def double_sort(df: DataFrame, first: str, second: str, value: str, q1: int, q2: int, date: str = "date") -> DataFrame:
    """Sequential: buckets by ``second`` within those by ``first``."""
    one = quantile_bucket(df, first, q1, [date], "bucket1")
    two = quantile_bucket(one, second, q2, [date, "bucket1"], "bucket2")
    return two.groupBy(date, "bucket1", "bucket2").agg(F.avg(value).alias(value))


def rebalanced(weights: DataFrame, returns: DataFrame, method: str = "continuous", date: str = "date") -> DataFrame:
    """Return of each date of weights set on sampling dates: ``continuous`` keeps the weights
    through the holding period, ``discrete`` lets them drift with the assets' own returns."""
    if method not in ("continuous", "discrete"):
        raise ValueError(f"method must be continuous or discrete, not {method!r}")
    held = returns.withColumn("ret", F.coalesce("ret", F.lit(0.0))).join(weights.where(F.col("weight").isNotNull()), ["sampling_date", "permno"])
    if method == "discrete":
        w = Window.partitionBy("sampling_date", "permno").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
        grown = F.coalesce(F.product(1 + F.col("ret")).over(w), F.lit(1.0))
        held = held.withColumn("weight", F.col("weight") * grown)
    sums = held.groupBy("sampling_date", date).agg(F.sum(F.col("ret") * F.col("weight")).alias("_r"), F.sum("weight").alias("_w"))
    return sums.select("sampling_date", date, (F.col("_r") if method == "continuous" else ratio(F.col("_r"), F.col("_w"))).alias("ret"))


def performance(returns: DataFrame, ret: str = "ret", periods: int = 12) -> DataFrame:
    """mean, vol (both annual), sharpe, and worst drawdown of one return series, by date."""
    w = Window.orderBy("date")  # one row a date
    path = returns.withColumn("_v", F.exp(F.sum(F.ln(1 + F.col(ret))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    path = path.withColumn("_d", F.col("_v") / F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    mean, vol = F.avg(ret) * periods, F.stddev_samp(ret) * (periods**0.5)
    return path.agg(mean.alias("mean"), vol.alias("vol"), ratio(mean, vol).alias("sharpe"), F.min("_d").alias("drawdown"))


def rank_weights(df: DataFrame, by: str) -> Column:
    return average_rank(F.col(by), "date")
