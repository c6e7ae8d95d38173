"""Selection of the largest assets of each sampling date, for all dates in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, suffix_duplicates

MEASURES = ("mcap", "mcap_volatility", "value_vola")


def company_sums(rows: DataFrame, key: tuple[str, ...] = ("date", "permco")) -> DataFrame:
    """mcap is the company's sum of the date, permno_mcap the security's own."""
    company = F.coalesce(F.sum("mcap").over(Window.partitionBy(*key)), F.lit(0.0))
    return rows.withColumn("permno_mcap", F.col("mcap")).withColumn("mcap", company)


def representative(samples: DataFrame) -> DataFrame:
    """Of each company the securities with the greatest median variance (ties all stay, companies
    without any variance go), with company_sums(): of all the samples, unless their rows had
    them before they were copied to their sampling dates."""
    if "permno_mcap" not in samples.columns:
        samples = company_sums(samples, ("sampling_date", "date", "permco"))
    medians = samples.groupBy("sampling_date", "permco", "permno").agg(F.median("var").alias("_m"))
    best = medians.withColumn("_t", F.max("_m").over(Window.partitionBy("sampling_date", "permco"))).where("_m = _t")
    return samples.join(best.select("sampling_date", "permno"), ["sampling_date", "permno"], "left_semi")


def summary(samples: DataFrame, ahead: DataFrame) -> DataFrame:
    """Characteristics, eligibility flags and ranks of every asset of every sampling date.

    last_ is the value on the sample's last date, carried over at most one date; an asset is
    ranked if it has more than 99 % of the dates and is seen ahead (or nobody is)."""
    key = ["sampling_date", "permno"]
    vol = F.sqrt(F.coalesce("var", "noisevar"))
    rows = samples.withColumn("_vol", vol).withColumn("_mv", F.col("mcap") * vol)
    dates = samples.select("sampling_date", "date").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("sampling_date").orderBy(F.desc("date"))))
    bounds = dates.groupBy("sampling_date").agg(F.count(F.lit(1)).alias("_dates"), F.max("date").alias("_last"), F.max(F.when(F.col("_k") == 2, F.col("date"))).alias("_before"))
    rows = rows.join(bounds, "sampling_date")

    def last(x: str) -> F.Column:
        at = F.when((F.col("date") >= F.coalesce("_before", "_last")) & F.col(x).isNotNull(), F.col("date"))
        return F.max_by(x, at)

    stats = rows.groupBy(*key).agg(
        F.max_by("ticker", "date").alias("ticker"), (F.count("ret") > F.lit(0.99) * F.first("_dates")).alias("has_all_days"),
        last("mcap").alias("last_mcap"), F.avg("mcap").alias("mean_mcap"), last("_mv").alias("last_mcap_volatility"), F.avg("_mv").alias("mean_mcap_volatility"),
        (F.avg("mcap") * F.avg("_vol")).alias("value_vola"),
    )
    seen = ahead.select(*key).distinct().withColumn("_seen", F.lit(True))
    return ranked(stats.join(seen, key, "left").withColumn("_seen", F.coalesce("_seen", F.lit(False))))


def ranked(stats: DataFrame) -> DataFrame:
    """stats, with a column _seen, as summary() returns them: with has_next_obs and the ranks of eligible assets."""
    anyone = F.max("_seen").over(Window.partitionBy("sampling_date"))
    out = stats.withColumn("has_next_obs", F.col("_seen") | ~anyone).drop("_seen")
    ok = F.col("has_all_days") & F.col("has_next_obs")
    for c in ("last_mcap", "mean_mcap", "last_mcap_volatility", "mean_mcap_volatility", "value_vola"):
        out = out.withColumn("_x", F.when(ok, F.col(c))).withColumn(f"{c}_rank", average_rank(F.col("_x"), "sampling_date")).drop("_x")
    return out


def select_largest(described: DataFrame, n: int, method: str = "mean", variable: str = "mcap") -> DataFrame:
    """The n best ranked assets of each date, unranked ones last, as asset_order 1 ... n."""
    column = f"{method}_{variable}_rank" if f"{method}_{variable}_rank" in described.columns else f"{variable}_rank"
    if column not in described.columns:
        raise ValueError(f"no rank for method {method!r} and variable {variable!r}")
    w = Window.partitionBy("sampling_date").orderBy(F.col(column).asc_nulls_last(), "permno")
    chosen = described.withColumn("asset_order", F.row_number().over(w)).where(F.col("asset_order") <= n)
    return chosen.withColumn("ticker", suffix_duplicates(F.col("ticker"), ["sampling_date"], "asset_order"))


def attributes(rows: DataFrame, codes: list[str]) -> DataFrame:
    """The last known value of each code, by asset."""
    return rows.groupBy("permno").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in codes])
