"""Characteristics of rolling samples from monthly states, without copying rows to sampling dates.

A month of an asset is reduced to a state that can be merged: counts and sums, the last value with
its day, a bit for each day it was seen, and the values whose median is wanted. A sample of so many months
is a frame of as many states, so the panel is shuffled once for its states, and what goes by sampling
date is one row an asset and month. An asset's months without rows are filled up with empty states as
far as a sample reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .sampling import company_sums, ranked, select_largest

#: Columns of which a sample's last value is wanted.
LAST = ("mcap", "mcap_volatility")


def month_of(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def sampling_date(month: Column) -> Column:
    return F.last_day(F.make_date((month / 12).cast("int"), month % 12 + 1, F.lit(1)))


def states(rows: DataFrame) -> DataFrame:
    """A row an asset, company and month (m): what samples are put together from. Days are
    coded as 32 * m + day, so that they can be compared and come from bits."""
    vol = F.sqrt(F.coalesce("var", "noisevar"))
    day = F.dayofmonth("date")
    r = rows.withColumn("m", month_of(F.col("date"))).withColumn("_vol", vol).withColumn("mcap_volatility", F.col("mcap") * vol).withColumn("_at", F.col("m") * 32 + day)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("x")))).alias(f"last_{c}") for c in LAST]
    sums = [f(c).alias(f"{n}_{c}") for c in ("mcap", "mcap_volatility", "_vol") for n, f in (("sum", F.sum), ("n", F.count))]
    return r.groupBy("permno", "permco", "m").agg(
        F.count("ret").alias("n_ret"), *sums, *last, F.max(F.struct("_at", F.col("ticker").alias("x"))).alias("ticker"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), day - 1)).alias("days"), F.collect_list("var").alias("vars"),
    )


def filled(held: DataFrame, months: int) -> DataFrame:
    """The states, and empty ones (days is null) for months whose sample holds rows of the asset but that have none."""
    end = held.agg(F.max("m").alias("_end"))  # one row
    ahead = F.lead("m").over(Window.partitionBy("permno", "permco").orderBy("m"))
    own = [c for c in held.columns if c not in ("permno", "permco", "m")]
    out = held.withColumn("_to", ahead).join(F.broadcast(end)).withColumn("_to", F.least(F.coalesce(F.col("_to") - 1, F.col("m") + months - 1), F.col("m") + months - 1, F.col("_end")))
    out = out.withColumn("_k", F.explode(F.sequence("m", "_to")))
    return out.select("permno", "permco", F.col("_k").alias("m"), *[F.when(F.col("_k") == F.col("m"), F.col(c)).alias(c) for c in own])


def median(values: Column) -> Column:
    """Of an array without nulls; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(s, k.cast("int"))
    return F.when(n > 0, 0.5 * at(F.floor((n - 1) / 2)) + 0.5 * at(F.floor(n / 2)))


def summary(rows: DataFrame, months: int, ahead: int | None = None) -> DataFrame:
    """sampling.summary() of the representative securities of every month end's sample of so many months;
    an asset is seen ahead if it has a row in the next ``ahead`` months (as many, if not given)."""
    held = filled(states(company_sums(rows) if "permno_mcap" not in rows.columns else rows), months)
    by = Window.partitionBy("permno").orderBy("m")
    back = by.rangeBetween(1 - months, 0)
    company = Window.partitionBy("permno", "permco").orderBy("m").rangeBetween(1 - months, 0)
    stats = [F.sum(c).over(back).alias(c) for c in held.columns if c.startswith(("sum_", "n_"))]
    stats += [F.max(c).over(back).alias(c) for c in ("ticker", *(f"last_{c}" for c in LAST))]
    found = held.select(
        "permno", "permco", "m", *stats, F.collect_list(F.when(F.col("days").isNotNull(), F.struct("m", "days"))).over(back).alias("seen_days"),
        median(F.flatten(F.collect_list("vars").over(company))).alias("_m"),
        F.max(F.col("days").isNotNull()).over(by.rangeBetween(1, ahead or months)).alias("_seen"),
    )
    best = found.withColumn("_t", F.max("_m").over(Window.partitionBy("m", "permco"))).where("_m = _t").drop("permco", "_m", "_t")
    best = best.dropDuplicates(["m", "permno"])  # an asset of several companies has the same stats in each
    days = best.select(F.col("m").alias("_s"), F.explode("seen_days").alias("d")).groupBy("_s", F.col("d.m").alias("m")).agg(F.bit_or("d.days").alias("days"))
    codes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.col("days").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0), lambda k: F.col("m") * 32 + k + 1)
    ends = days.select("_s", codes.alias("c")).groupBy("_s").agg(F.sort_array(F.flatten(F.collect_list("c")), asc=False).alias("c"))  # 31 a month at most
    bounds = ends.select(F.col("_s").alias("m"), F.size("c").alias("_dates"), F.coalesce(F.get("c", F.lit(1)), F.get("c", F.lit(0))).alias("_before"))
    r = best.join(F.broadcast(bounds), "m")  # one row a month
    last = {f"last_{c}": F.when(F.col(f"last_{c}._at") >= F.col("_before"), F.col(f"last_{c}.x")) for c in LAST}
    mean = {f"mean_{c}": ratio(F.col(f"sum_{c}"), F.col(f"n_{c}")) for c in LAST}
    out = r.select(
        sampling_date(F.col("m")).alias("sampling_date"), "permno", F.col("ticker.x").alias("ticker"), (F.col("n_ret") > F.lit(0.99) * F.col("_dates")).alias("has_all_days"),
        last["last_mcap"].alias("last_mcap"), mean["mean_mcap"].alias("mean_mcap"), last["last_mcap_volatility"].alias("last_mcap_volatility"), mean["mean_mcap_volatility"].alias("mean_mcap_volatility"),
        (mean["mean_mcap"] * ratio(F.col("sum__vol"), F.col("n__vol"))).alias("value_vola"), F.coalesce("_seen", F.lit(False)).alias("_seen"),
    )
    return ranked(out)


def sample_panel(rows: DataFrame, months: int, n: int, method: str = "mean", variable: str = "mcap") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(historic, future, selection) of all sampling dates: rows meet only the samples that chose their asset."""
    rows = company_sums(rows)
    chosen = select_largest(summary(rows, months), n, method, variable)
    held = chosen.select("sampling_date", "permno", "asset_order", month_of(F.col("sampling_date")).alias("_s"))

    def legs(first: int, last: int, columns: DataFrame) -> DataFrame:
        months_of = held.withColumn("_month", F.explode(F.sequence(F.col("_s") + first, F.col("_s") + last))).drop("_s")
        return columns.withColumn("_month", month_of(F.col("date"))).join(months_of, ["permno", "_month"]).drop("_month")

    future = rows.withColumn("mcap", F.col("permno_mcap")).drop("permno_mcap")
    return legs(1 - months, 0, rows), legs(1, months, future), chosen
