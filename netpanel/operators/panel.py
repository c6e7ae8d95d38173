"""Relational panel operators: interval joins, upserts, sampling windows, aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_end, ratio

#: Series of a block of pairs at least, blocks of a panel at most while a block's cells (series x dates) allow it.
BLOCK, BLOCKS, CELLS = 256, 16, 1 << 21
#: Series of a tile of pairs, which is computed and given out at once.
TILE = 512
#: Pairs of a series that are given out before the same ones the other way round.
RUN = 32


def interval_join(facts: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Facts with the interval rows of their key that are valid on their date: a hash join on
    the key with the range as its residual condition."""
    i = intervals.withColumnRenamed(key, "_key")
    return facts.join(i, (F.col(key) == F.col("_key")) & F.col(at).between(F.col(start), F.col(end)), how).drop("_key")


def as_of(intervals: DataFrame, date: Column, start: str = "namedt", end: str = "nameendt") -> DataFrame:
    return intervals.where((F.col(start) <= date) & (F.col(end) >= date))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys; columns of both come from ``new``; rows without any measure go."""
    kept = old.drop(*[c for c in new.columns if c not in keys])
    joined = kept.join(new, list(keys), "full_outer")
    return joined.na.drop("all", subset=[c for c in joined.columns if c not in keys])


def outer_chain(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full_outer")
    return out


def join_with_suffix(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys), "left")


def date_slice(df: DataFrame, start: str | None = None, end: str | None = None, time: str = "date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(time) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(time) <= F.to_date(F.lit(end)))
    return df


def month_ends(df: DataFrame, time: str = "date") -> DataFrame:
    """sampling_date: every month end from the first to the last date of df."""
    ends = df.agg(F.last_day(F.min(time)).alias("a"), F.last_day(F.max(time)).alias("b"))
    months = F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month")))
    return ends.select(months.alias("m")).select(F.last_day("m").alias("sampling_date"))


def rolling_samples(df: DataFrame, months: int, time: str = "date") -> DataFrame:
    """Each row once for each sampling date whose window of so many months holds it. The row
    makes its own sampling dates, so nothing is joined; dates beyond the panel's last month go."""
    last = df.agg(F.last_day(F.max(time)).alias("_last"))  # one row
    dates = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.last_day(F.add_months(F.trunc(time, "MM"), k)))
    return df.withColumn("sampling_date", F.explode(dates)).join(F.broadcast(last), F.col("sampling_date") <= F.col("_last")).drop("_last")


def forward_samples(df: DataFrame, months: int, time: str = "date") -> DataFrame:
    """Each row once for each sampling date whose next so many months hold it."""
    first = df.agg(F.last_day(F.min(time)).alias("_first"))  # one row
    dates = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda k: F.last_day(F.add_months(F.trunc(time, "MM"), -k)))
    return df.withColumn("sampling_date", F.explode(dates)).join(F.broadcast(first), F.col("sampling_date") >= F.col("_first")).drop("_first")


def own_month(samples: DataFrame, time: str = "date", forward: bool = False) -> DataFrame:
    """Of each sample only its own last month, or its first month ahead."""
    sd, d = F.col("sampling_date"), F.col(time)
    if forward:
        return samples.where((d > sd) & (d <= month_end(sd, 1)))
    return samples.where((d > month_end(sd, -1)) & (d <= sd))


def horizons(df: DataFrame, sampling: str, time: str, spans: Sequence[int], last: Column) -> DataFrame:
    """Rows ahead of their sampling date once for each horizon that holds them and that the panel covers."""
    spark = df.sparkSession
    h = spark.createDataFrame([(s,) for s in spans], "horizon int")
    ahead = (F.col(time) > F.col(sampling)) & (F.col(time) <= month_end(F.col(sampling), F.col("horizon")))
    return df.join(F.broadcast(h), ahead & (month_end(F.col(sampling), F.col("horizon")) <= last))


def compounded(ret: str) -> Column:
    """Product of 1 + r, less 1; missing returns are skipped and nothing compounds to 0."""
    return F.coalesce(F.product(1 + F.col(ret)), F.lit(1.0)) - 1


def weighted_mean(x: str, w: str) -> Column:
    """Sum of x * w / sum of w; a missing x loses its weight's part but not its weight."""
    return ratio(F.coalesce(F.sum(F.col(x) * F.col(w)), F.lit(0.0)), F.sum(w))


def herfindahl(x: str) -> Column:
    return ratio(F.sum(F.col(x) * F.col(x)), F.pow(F.sum(x), 2))


def power_law(df: DataFrame, x: str, by: Sequence[str], name: str = "exponent") -> DataFrame:
    """Pareto tail exponent of the positive values of each group."""
    w = Window.partitionBy(*by)
    positive = df.where(F.col(x) > 0).withColumn("_r", F.ln(F.col(x) / F.min(x).over(w)))
    return positive.groupBy(*by).agg((1 + ratio(F.count("_r"), F.sum("_r"))).alias(name))


def entropy(df: DataFrame, x: str, by: Sequence[str], name: str = "entropy") -> DataFrame:
    """Entropy of the shares of each group, in units of the logarithm of its size."""
    p = ratio(F.col(x), F.sum(x).over(Window.partitionBy(*by)))
    shares = df.withColumn("_p", p)
    return shares.groupBy(*by).agg(ratio(-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p"))), F.ln(F.count(F.lit(1)))).alias(name))


def pairs(df: DataFrame, x: str, key: str, time: str, lag: int = 0) -> DataFrame:
    """(i, j, x_i, x_j) of every date on which both have values: for small panels, where each
    date's values of a pair are wanted; moments of many pairs come from pair_moments()."""
    a = df.select(F.col(time), F.col(key).alias("i"), F.col(x).alias("x_i"))
    shifted = F.col(time) if lag == 0 else F.col("_next")
    b = df
    if lag:
        b = df.withColumn("_next", F.lead(time, lag).over(Window.partitionBy(key).orderBy(time)))
    b = b.select(shifted.alias(time), F.col(key).alias("j"), F.col(x).alias("x_j"))
    return a.join(b, time)


def _block_pairs(df: DataFrame, x: str, key: str, time: str, lag: int, block: int | None) -> DataFrame:
    """Every series (k, t, v: its dates and values as arrays) once for each pair of blocks (bi, bj) it takes
    part in, right: as the second of them. Without a lag bi <= bj, and bi = bj holds a series once."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(time).alias("t"), F.col(x).cast("double").alias("v"))

    def packed(rows: DataFrame) -> DataFrame:
        # in order of time, so that the dates of series are alike and copies of them compress
        return rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s")).select("k", F.col("s.t").alias("t"), F.col("s.v").alias("v"))

    panel = packed(rows).persist()  # read for its size and for its copies, made once
    size = panel.select("k", F.explode("t").alias("t")).agg(F.approx_count_distinct("k").alias("n"), F.approx_count_distinct("t").alias("t")).first()
    if block is None:
        block = max(1, min(max(BLOCK, -(-size.n // BLOCKS)), CELLS // max(1, size.t)))
    blocks = max(1, -(-size.n // block))

    def series(packed: DataFrame) -> DataFrame:
        return packed.select("k", "t", "v", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))

    if not lag:
        return series(panel).select("k", "t", "v", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).alias("right"))
    later = rows.withColumn("t", F.lead("t", lag).over(Window.partitionBy("k").orderBy("t"))).where("t is not null")
    left = series(panel).select("k", "t", "v", F.col("own").alias("bi"), F.col("other").alias("bj"), F.lit(False).alias("right"))
    return left.unionByName(series(packed(later)).select("k", "t", "v", F.col("other").alias("bi"), F.col("own").alias("bj"), F.lit(True).alias("right")))


def _centred(t: pa.Table, at: np.ndarray, dates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their series less their means (0 where missing) and 1 where they have values; complete series
    come first, so that whole tiles of them need one product."""
    values = t.column("v").combine_chunks()
    m = np.full((t.num_rows, dates), np.nan)
    m[np.repeat(np.arange(t.num_rows), values.value_lengths().to_numpy()), at] = values.flatten().to_numpy()
    here = ~np.isnan(m)
    order = np.argsort(~here.all(axis=1), kind="stable")
    m, here = m[order], here[order]
    mean = np.where(here, m, 0).sum(axis=1) / np.maximum(here.sum(axis=1), 1)
    return t.column("k").to_numpy()[order], np.where(here, m - mean[:, None], 0), here.astype(float)


def _tiles(batches: Iterator[pa.RecordBatch], lag: int) -> Iterator[tuple]:
    """(i, j, count, cov, corr, mirrored) of the pairs of two blocks, tile by tile: mirrored tiles hold each
    unordered pair once, the others both ways."""
    table = pa.Table.from_batches(list(batches)).select(["k", "t", "v", "right"])
    sides = [table.filter(pc.invert(table.column("right"))), table.filter(table.column("right"))]
    flat = [s.column("t").combine_chunks().flatten() for s in sides]
    coded = pa.concat_arrays(flat).dictionary_encode()
    at, dates = coded.indices.to_numpy(), len(coded.dictionary)
    a = _centred(sides[0], at[: len(flat[0])], dates)
    b = _centred(sides[1], at[len(flat[0]) :], dates)
    same = not lag and not len(b[0])
    if same:
        b = a
    whole = [m.min(axis=1, initial=1) > 0 for m in (a[2], b[2])]
    squares = [x**2 for x in (a[1], b[1])]
    totals = [s.sum(axis=1) for s in squares]
    for p in range(0, len(a[0]), TILE):
        for q in range(p if same else 0, len(b[0]), TILE):
            l, r = slice(p, p + TILE), slice(q, q + TILE)
            xa, ma, xb, mb = a[1][l], a[2][l], b[1][r], b[2][r]
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = xa @ xb.T
                if whole[0][l].all() and whole[1][r].all():
                    count = np.full(cross.shape, float(dates))
                    va, vb = totals[0][l][:, None], totals[1][r][None, :]
                else:
                    count, sa, sb = ma @ mb.T, xa @ mb.T, ma @ xb.T
                    cross -= sa * sb / count
                    va, vb = squares[0][l] @ mb.T - sa**2 / count, ma @ squares[1][r].T - sb**2 / count
                cov = np.where(count > 1, cross / (count - 1), np.nan)
                tiny = 1e-24 * count
                corr = np.where((count > 1) & (va > tiny) & (vb > tiny), np.clip(cross / np.sqrt(va * vb), -1, 1), np.nan)
            yield a[0][l], b[0][r], count, cov, corr, not lag and not (same and p == q)


def pair_moments(df: DataFrame, x: str, key: str, time: str, lag: int = 0, upper: bool = False, block: int | None = None) -> DataFrame:
    """(i, j, corr, cov) of all pairs, pairwise complete; with a lag, of x_i today and x_j so many
    rows before; upper: only i < j.

    Series are dealt into blocks, and each pair of blocks is one task's matrix products, which it gives
    out tile by tile. The blocks grow with the panel up to CELLS values, so a series travels about BLOCKS
    times at most until there are BLOCKS * CELLS values, and no pair's dates are joined."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ki, kj, count, cov, corr, mirrored in _tiles(batches, lag):
            i, j = np.broadcast_arrays(ki[:, None], kj)
            keep = count > 0
            if upper and mirrored:
                i, j = np.minimum(i, j), np.maximum(i, j)
            elif upper:
                keep &= i < j
            elif mirrored:
                # some pairs of a series, then the same the other way round: a file's compression finds their values again
                at = np.argsort(np.tile(np.arange(len(kj)) // RUN, 2), kind="stable")
                i, j = np.hstack([i, j])[:, at], np.hstack([j, i])[:, at]
                keep, corr, cov = (np.hstack([m, m])[:, at] for m in (keep, corr, cov))
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), *(pa.array(m[keep], from_pandas=True) for m in (corr, cov))], ["i", "j", "corr", "cov"])

    return _block_pairs(df, x, key, time, lag, block).groupBy("bi", "bj").applyInArrow(products, "i long, j long, corr double, cov double")


def mean_correlation(df: DataFrame, x: str, key: str = "permno", time: str = "date", block: int | None = None, name: str = "mean") -> DataFrame:
    """Mean over all pairs i < j of their pairwise complete correlations, where they have one: pairs of blocks
    give out their sums, no pair leaves its task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for ki, kj, _, _, corr, mirrored in _tiles(batches, 0):
            some = ~np.isnan(corr) if mirrored else ~np.isnan(corr) & (ki[:, None] < kj[None, :])
            total, n = total + float(corr[some].sum()), n + int(some.sum())
        yield pa.RecordBatch.from_pydict({"s": [total], "n": [n]})

    parts = _block_pairs(df, x, key, time, 0, block).groupBy("bi", "bj").applyInArrow(sums, "s double, n long")
    return parts.agg(ratio(F.sum("s"), F.sum("n")).alias(name))


def correlations(df: DataFrame, x: str, key: str = "permno", time: str = "date", lag: int = 0, upper: bool = False) -> DataFrame:
    return pair_moments(df, x, key, time, lag, upper).select("i", "j", "corr")


def covariances(df: DataFrame, x: str, key: str = "permno", time: str = "date") -> DataFrame:
    return pair_moments(df, x, key, time).select("i", "j", "cov")


def top_sum(df: DataFrame, order: str, total: str, k: int, by: str) -> DataFrame:
    """Sum of ``total`` over the k rows of each group that are largest by ``order``."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc_nulls_last(), "permno")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(by).agg(F.sum(total).alias("top"))


def cumulative_share(df: DataFrame, x: str, by: str, tie: str) -> DataFrame:
    """Adds rank and cum_share in descending order of x."""
    w = Window.partitionBy(by).orderBy(F.col(x).desc(), tie)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("_c", F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("cum_share", ratio(F.col("_c"), F.sum(x).over(Window.partitionBy(by)))).drop("_c")


def last_row(df: DataFrame, columns: Sequence[str], key: str, time: str) -> DataFrame:
    """The values of each key's last row, missing ones included."""
    return df.groupBy(key).agg(*[F.max_by(c, time).alias(c) for c in columns])


def peaks(df: DataFrame, x: str, least: float, key: str = "permno", time: str = "date") -> DataFrame:
    """For each key whose greatest x reaches the bound: the first date of it and its value."""
    first = F.min(F.struct((-F.col(x)).alias("v"), F.col(time).alias("d"))).alias("_p")
    return df.where(F.col(x).isNotNull()).groupBy(key).agg(F.max(x).alias("peak"), first).where(F.col("peak") >= least).select(key, F.col("_p.d").alias(time), "peak")
