"""Queries for windows, reshaping, scalar functions, sampling and index building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import windows as X
from ..operators import indices as I
from ..operators import panel as P
from ..operators import sampling as S
from ..operators import sliding as SL
from ..sources import tables as T
from ..sources.tables import DAILY, MARKET, MONTHLY, NAMES, SECURITIES
from .registry import query
from .relational import DENSE, FUTURE, HORIZON_VALUES, HORIZONS, SAMPLES, futures, samples

BY = "OVER (PARTITION BY permno ORDER BY date"


# --- windows -------------------------------------------------------------------------


@query("rank_avg_desc", "permno:i date:d rank:f2", f"WITH {MONTHLY}, x AS (SELECT *, CASE WHEN ret > -0.03 THEN round(vol, 3) END AS v FROM m) SELECT permno, date, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 END AS rank FROM x")
def rank_avg_desc(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf).withColumn("v", F.when(F.col("ret") > -0.03, F.round("vol", 3)))
    return m.withColumn("rank", X.average_rank(F.col("v"), "date"))


BUCKETS = "b AS (SELECT m.*, 1 + len(list_filter(q, lambda x: round(mcap, 10) > round(x, 10))) AS bucket FROM m JOIN (SELECT date, quantile_cont(mcap, [0.2, 0.4, 0.6, 0.8]) AS q FROM m GROUP BY 1) USING (date))"


@query("qcut5", "permno:i date:d bucket:i", f"WITH {MONTHLY}, {BUCKETS} SELECT permno, date, bucket FROM b")
def qcut5(spark: SparkSession, sf: str) -> DataFrame:
    return X.quantile_bucket(T.monthly(spark, sf), "mcap", 5, ["date"])


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return X.densify(T.daily(spark, sf))


@query("ffill", "permno:i date:d x:f4", f"WITH {DAILY}, {DENSE} SELECT permno, date, last_value(mcap IGNORE NULLS) {BY} ROWS UNBOUNDED PRECEDING) AS x FROM g")
def ffill(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).withColumn("x", X.ffill("mcap", X.over_time()))


@query("bfill", "permno:i date:d x:f4", f"WITH {DAILY}, {DENSE} SELECT permno, date, first_value(mcap IGNORE NULLS) {BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM g")
def bfill(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).withColumn("x", X.bfill("mcap", X.over_time()))


@query("ffill_limit1", "permno:i date:d x:f4", f"WITH {DAILY}, {DENSE} SELECT permno, date, last_value(mcap IGNORE NULLS) {BY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM g")
def ffill_limit1(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).withColumn("x", X.ffill("mcap", X.over_time(), 1))


@query("pct_change", "permno:i date:d x:f8", f"WITH {MONTHLY} SELECT permno, date, mcap / lag(mcap) {BY}) - 1 AS x FROM m")
def pct_change(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).withColumn("x", X.pct_change(F.col("mcap"), X.over_time()))


@query("diff", "permno:i date:d x:f2", f"WITH {MONTHLY} SELECT permno, date, mcap - lag(mcap) {BY}) AS x FROM m")
def diff(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).withColumn("x", F.col("mcap") - F.lag("mcap").over(X.over_time()))


RANGE = f"{BY} RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)"
ROLLED = f"r AS (SELECT *, CASE WHEN count(ret) {RANGE} >= 6 THEN avg(ret) {RANGE} END AS mean, CASE WHEN count(ret) {RANGE} >= 6 THEN stddev_samp(ret) {RANGE} END AS std FROM m)"


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    mean, std = X.rolling_moments(F.col("ret"), X.rolling_days("permno", "date", 365), 6)
    return T.monthly(spark, sf).withColumn("mean", mean).withColumn("std", std)


@query("rolling_365d", "permno:i date:d mean:f8 std:f8", f"WITH {MONTHLY}, {ROLLED} SELECT permno, date, mean, std FROM r")
def rolling_365d(spark: SparkSession, sf: str) -> DataFrame:
    return rolled(spark, sf)


@query("inv_vol_weights", "permno:i date:d weight:f8", f"WITH {MONTHLY}, {ROLLED}, i AS (SELECT permno, date, 1 / nullif(lag(std, 3) {BY}), 0) AS v FROM r) SELECT permno, date, v / sum(v) OVER (PARTITION BY date) AS weight FROM i")
def inv_vol_weights(spark: SparkSession, sf: str) -> DataFrame:
    r = rolled(spark, sf).withColumn("v", C.ratio(F.lit(1.0), F.lag("std", 3).over(X.over_time())))
    return r.withColumn("weight", X.share(F.col("v"), Window.partitionBy("date")))


@query("rolling12_rows", "permno:i date:d mean:f8", f"WITH {MONTHLY} SELECT permno, date, CASE WHEN count(ret) {BY} ROWS 11 PRECEDING) = 12 THEN avg(ret) {BY} ROWS 11 PRECEDING) END AS mean FROM m")
def rolling12_rows(spark: SparkSession, sf: str) -> DataFrame:
    mean, _ = X.rolling_moments(F.col("ret"), X.over_time().rowsBetween(-11, 0), 12)
    return T.monthly(spark, sf).withColumn("mean", mean)


@query("group_normalize", "permno:i date:d share:f8 equal:f8", f"WITH {MONTHLY} SELECT permno, date, mcap / sum(mcap) OVER (PARTITION BY date) AS share, 1.0 / count(*) OVER (PARTITION BY date) AS equal FROM m")
def group_normalize(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("date")
    return T.monthly(spark, sf).withColumn("share", X.share(F.col("mcap"), w)).withColumn("equal", 1 / F.count(F.lit(1)).over(w))


@query("gross_leverage", "permno:i date:d weight:f8", f"WITH {MONTHLY} SELECT permno, date, 2 * ret / nullif(sum(abs(ret)) OVER (PARTITION BY date), 0) AS weight FROM m")
def gross_leverage(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).withColumn("weight", C.ratio(2 * F.col("ret"), F.sum(F.abs("ret")).over(Window.partitionBy("date"))))


@query("zscore_ts", "permno:i date:d z:f6", f"WITH {MONTHLY} SELECT permno, date, (ret - avg(ret) OVER (PARTITION BY permno)) / nullif(stddev_samp(ret) OVER (PARTITION BY permno), 0) AS z FROM m")
def zscore_ts(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).withColumn("z", X.zscore(F.col("ret"), Window.partitionBy("permno")))


@query("clip_q99", "permno:i date:d x:f4", f"WITH {MONTHLY} SELECT permno, date, least(mcap, q) AS x FROM m JOIN (SELECT date, quantile_cont(mcap, 0.99) AS q FROM m GROUP BY 1) USING (date)")
def clip_q99(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf)
    caps = m.groupBy("date").agg(F.percentile("mcap", F.lit(0.99)).alias("q"))
    return m.join(caps, "date").withColumn("x", F.when(F.col("mcap").isNotNull(), F.least("mcap", "q")))


@query("annual_autocorr", "mean_autocorr:f8", f"WITH {MONTHLY}, y AS (SELECT permno, mcap, lag(mcap) {BY}) AS p FROM m WHERE month(date) = 12) SELECT avg(c) AS mean_autocorr FROM (SELECT corr(mcap, p) AS c FROM y GROUP BY permno)")
def annual_autocorr(spark: SparkSession, sf: str) -> DataFrame:
    y = T.monthly(spark, sf).where(F.month("date") == 12).withColumn("p", F.lag("mcap").over(X.over_time()))
    return y.groupBy("permno").agg(F.corr("mcap", "p").alias("c")).agg(F.avg("c").alias("mean_autocorr"))


@query("annual_persistence", "permno:i autocorr:f8", f"WITH {MONTHLY}, y AS (SELECT permno, vol, lag(vol) {BY}) AS p FROM m WHERE month(date) = 12) SELECT permno, corr(vol, p) AS autocorr FROM y GROUP BY permno")
def annual_persistence(spark: SparkSession, sf: str) -> DataFrame:
    y = T.monthly(spark, sf).where(F.month("date") == 12).withColumn("p", F.lag("vol").over(X.over_time()))
    return y.groupBy("permno").agg(F.corr("vol", "p").alias("autocorr"))


REGIONS = "v AS (SELECT n_regionkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS date, round(ln(sum(l_extendedprice)), 8) AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Five regions by month, log turnover: the small complete panel of the vector models."""
    l, s, n = (T.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    sup = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    joined = l.select("l_suppkey", "l_shipdate", "l_extendedprice").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("n_regionkey").cast("bigint").alias("permno"), F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg(F.round(F.ln(F.sum("l_extendedprice")), 8).alias("x"))


@query("autocorr_matrix", "i:i j:i corr:f8", f"WITH {REGIONS}, b AS (SELECT permno, x, lead(date) {BY}) AS date FROM v) SELECT v.permno AS i, b.permno AS j, corr(v.x, b.x) AS corr FROM v JOIN b USING (date) GROUP BY 1, 2")
def autocorr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return P.correlations(regions(spark, sf), "x", lag=1)


@query("expanding_windows", "permno:i horizon:i ret:f8 var:f8", f"""WITH {MONTHLY} SELECT permno, h AS horizon, product(1 + ret) - 1 AS ret, var_samp(ret) * 252 AS var FROM m, {HORIZON_VALUES} v(h)
  WHERE date > DATE '1998-12-31' AND date <= last_day(CAST(DATE '1998-12-31' + to_months(CAST(h AS INTEGER)) AS DATE)) GROUP BY 1, 2""")
def expanding_windows(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf).withColumn("sampling_date", F.to_date(F.lit("1998-12-31")))
    h = P.horizons(m, "sampling_date", "date", HORIZONS, F.to_date(F.lit("2099-12-31")))
    return h.groupBy("permno", "horizon").agg(P.compounded("ret").alias("ret"), (F.var_samp("ret") * 252).alias("var"))


@query("unique_tickers", "permno:i ticker:s", f"WITH {SECURITIES} SELECT permno, CASE WHEN ticker IS NOT NULL AND count(*) OVER (PARTITION BY permco, ticker) > 1 THEN ticker || '.' || chr(CAST(64 + row_number() OVER (PARTITION BY permco, ticker ORDER BY permno) AS INTEGER)) ELSE ticker END AS ticker FROM sec")
def unique_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return T.securities(spark, sf).withColumn("ticker", X.suffix_duplicates(F.col("ticker"), ["permco"], "permno"))


# --- sort, reshape, sets ---------------------------------------------------------------


@query("topn_select", "date:d permno:i k:i", f"WITH {MONTHLY} SELECT date, permno, row_number() OVER (PARTITION BY date ORDER BY vol DESC NULLS LAST, permno) AS k FROM m QUALIFY k <= 10")
def topn_select(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.col("vol").desc_nulls_last(), "permno")
    return T.monthly(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 10")


@query("sort_nulls", "date:d permno:i k:i vol:f8", f"WITH {MONTHLY} SELECT date, permno, row_number() OVER (PARTITION BY date ORDER BY vol DESC NULLS LAST, permno) AS k, vol FROM m")
def sort_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.col("vol").desc_nulls_last(), "permno")))


@query("last_row", "permno:i vol:f8 mcap:f2", f"WITH {MONTHLY} SELECT permno, vol, mcap FROM m QUALIFY row_number() OVER (PARTITION BY permno ORDER BY date DESC) = 1")
def last_row(spark: SparkSession, sf: str) -> DataFrame:
    return P.last_row(T.monthly(spark, sf), ["vol", "mcap"], "permno", "date")


@query("pivot_wide", "date:d r0:f8 r1:f8 r2:f8 r3:f8 r4:f8", f"WITH {REGIONS} SELECT date, {', '.join(f'max(CASE WHEN permno = {k} THEN x END) AS r{k}' for k in range(5))} FROM v GROUP BY 1")
def pivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = regions(spark, sf).groupBy("date").pivot("permno", [0, 1, 2, 3, 4]).agg(F.first("x"))
    return wide.withColumnsRenamed({str(k): f"r{k}" for k in range(5)})


@query("unpivot_long", "permno:i date:d measure:s value:f6", f"WITH {MONTHLY} SELECT permno, date, 'ret' AS measure, ret AS value FROM m WHERE ret IS NOT NULL UNION ALL SELECT permno, date, 'vol', vol FROM m WHERE vol IS NOT NULL")
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).unpivot(["permno", "date"], ["ret", "vol"], "measure", "value").where("value is not null")


YEARS = range(1995, 2002)  # all years of the tables: a wide result must name its columns


@query("transpose", f"permno:i {' '.join(f'y{y}:f2' for y in YEARS)}", f"WITH {MONTHLY} SELECT permno, {', '.join(f'sum(CASE WHEN year(date) = {y} THEN mcap END) AS y{y}' for y in YEARS)} FROM m GROUP BY 1")
def transpose(spark: SparkSession, sf: str) -> DataFrame:
    years = T.monthly(spark, sf).withColumn("y", F.concat(F.lit("y"), F.year("date")))
    return years.groupBy("permno").pivot("y", [f"y{y}" for y in YEARS]).agg(F.sum("mcap"))


@query("transpose_long", "permno:i year:i mcap:f2", f"WITH {MONTHLY} SELECT permno, year(date) AS year, sum(mcap) AS mcap FROM m GROUP BY 1, 2")
def transpose_long(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).groupBy("permno", F.year("date").alias("year")).agg(F.sum("mcap").alias("mcap"))


@query("reindex_order", "pos:i permno:i mean:f8", f"WITH {MONTHLY} SELECT pos, permno, mean FROM (VALUES (1, 7), (2, 3), (3, 100000), (4, 0)) w(pos, permno) LEFT JOIN (SELECT permno, avg(ret) AS mean FROM m GROUP BY 1) USING (permno)")
def reindex_order(spark: SparkSession, sf: str) -> DataFrame:
    order = spark.createDataFrame([(1, 7), (2, 3), (3, 100000), (4, 0)], "pos int, permno bigint")
    means = T.monthly(spark, sf).groupBy("permno").agg(F.avg("ret").alias("mean"))
    return order.join(means, "permno", "left")


@query("union_all", "permno:i date:d ret:f8 x:f8", f"WITH {MONTHLY}, {REGIONS} SELECT permno, date, ret, NULL AS x FROM m UNION ALL SELECT permno, date, NULL, x FROM v")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).select("permno", "date", "ret").unionByName(regions(spark, sf), allowMissingColumns=True)


@query("key_intersection", "permno:i", f"WITH {MONTHLY}, {DAILY} SELECT permno FROM m INTERSECT SELECT permno FROM d")
def key_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).select("permno").intersect(T.daily(spark, sf).select("permno"))


@query("matrix_reorder", "pi:i pj:i corr:f8", f"""WITH {REGIONS}, c AS (SELECT a.permno AS i, b.permno AS j, corr(a.x, b.x) AS corr FROM v a JOIN v b USING (date) GROUP BY 1, 2),
  o AS (SELECT permno, row_number() OVER (ORDER BY avg(x) DESC) AS pos FROM v GROUP BY 1) SELECT oi.pos AS pi, oj.pos AS pj, corr FROM c JOIN o oi ON oi.permno = i JOIN o oj ON oj.permno = j""")
def matrix_reorder(spark: SparkSession, sf: str) -> DataFrame:
    v = regions(spark, sf)
    order = v.groupBy("permno").agg(F.avg("x").alias("m")).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("m"))))  # one row an asset
    c = P.correlations(v, "x")
    return c.join(order.select(F.col("permno").alias("i"), F.col("pos").alias("pi")), "i").join(order.select(F.col("permno").alias("j"), F.col("pos").alias("pj")), "j")


@query("densify", "permno:i date:d mcap:f4", f"WITH {DAILY}, {DENSE} SELECT permno, date, mcap FROM g")
def densify(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf)


@query("rolling_std_lag21", "permno:i date:d z:f4", f"""WITH {DAILY}, {DENSE}, r AS (SELECT *, CASE WHEN count(mcap) OVER w >= 6 THEN avg(mcap) OVER w END AS mean, CASE WHEN count(mcap) OVER w >= 6 THEN stddev_samp(mcap) OVER w END AS std FROM g WINDOW w AS (PARTITION BY permno ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW))
  SELECT permno, date, (mcap - lag(mean, 21) {BY})) / nullif(lag(std, 21) {BY}), 0) AS z FROM r""")
def rolling_std_lag21(spark: SparkSession, sf: str) -> DataFrame:
    g = dense(spark, sf)  # every asset has a row on every date, so 21 rows are 21 dates
    mean, std = X.rolling_moments(F.col("mcap"), X.rolling_days("permno", "date", 365), 6)
    w = X.over_time()
    return g.withColumn("mean", mean).withColumn("std", std).withColumn("z", C.ratio(F.col("mcap") - F.lag("mean", 21).over(w), F.lag("std", 21).over(w)))


# --- scalar functions -------------------------------------------------------------------


@query("range_variance_log10", "permno:i date:d var:f10", f"WITH {DAILY} SELECT permno, date, CAST(0.3607 AS DOUBLE) * pow(log10(nullif(hi, 0)) - log10(nullif(lo, 0)), 2) AS var FROM d")
def range_variance_log10(spark: SparkSession, sf: str) -> DataFrame:
    return T.daily(spark, sf).withColumn("var", C.range_variance(F.col("hi"), F.col("lo"), base10=True))


@query("range_variance_ln", "permno:i date:d var:f8", f"WITH {DAILY} SELECT permno, date, CAST(0.3607 AS DOUBLE) * pow(ln(nullif(hi, 0)) - ln(nullif(lo, 0)), 2) AS var FROM d")
def range_variance_ln(spark: SparkSession, sf: str) -> DataFrame:
    return T.daily(spark, sf).withColumn("var", C.range_variance(F.col("hi"), F.col("lo")))


@query("market_cap", "trade:i line:i mcap:f2", "SELECT l_orderkey AS trade, l_linenumber AS line, l_quantity * l_extendedprice AS mcap FROM lineitem")
def market_cap(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("mcap"))


@query("math_ops", "permno:i date:d root:f8 logx:f8 ex:f8 sgn:i pw:f8 clipped:f8", f"WITH {MONTHLY} SELECT permno, date, CASE WHEN ret >= 0 THEN sqrt(ret) END AS root, ln(nullif(mcap, 0)) AS logx, exp(ret) AS ex, CAST(sign(ret) AS BIGINT) AS sgn, pow(abs(ret), 1.5) AS pw, greatest(least(ret, 0.02), -0.02) AS clipped FROM m")
def math_ops(spark: SparkSession, sf: str) -> DataFrame:
    m, r = T.monthly(spark, sf), F.col("ret")
    return m.select("permno", "date", F.when(r >= 0, F.sqrt(r)).alias("root"), C.ln(F.col("mcap")).alias("logx"), F.exp(r).alias("ex"), F.signum(r).alias("sgn"), F.pow(F.abs(r), 1.5).alias("pw"), F.greatest(F.least(r, F.lit(0.02)), F.lit(-0.02)).alias("clipped"))


FILLED = f"""a AS (SELECT *, nullif(noisevar, 0) AS f0, NOT max(noisevar IS NOT NULL) {BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nofill, min(nullif(noisevar, 0)) OVER (PARTITION BY permno) AS fmin FROM g),
  b AS (SELECT *, CASE WHEN nofill THEN NULL ELSE coalesce(last_value(f0 IGNORE NULLS) {BY} ROWS UNBOUNDED PRECEDING), fmin) END AS ff FROM a),
  c AS (SELECT *, CASE WHEN var IS NULL OR var = 0 THEN ff ELSE var END AS d1 FROM b),
  lf AS (SELECT permno, date, ln(coalesce(last_value(nullif(d1, 0) IGNORE NULLS) {BY} ROWS UNBOUNDED PRECEDING), min(nullif(d1, 0)) OVER (PARTITION BY permno))) AS x FROM c)"""


@query("log_fill", "permno:i date:d x:f6", f"WITH {DAILY}, {DENSE}, {FILLED} SELECT permno, date, x FROM lf")
def log_fill(spark: SparkSession, sf: str) -> DataFrame:
    return X.log_fill(dense(spark, sf), "var", "noisevar").withColumnRenamed("log_x", "x")


def _log_replace(method: str, sql: str) -> None:
    body = f"""WITH {DAILY}, {DENSE}, l AS (SELECT permno, date, ln(nullif(var, 0)) AS l, row_number() {BY}) AS i FROM g),
      n AS (SELECT *, CASE WHEN l IS NOT NULL THEN i END AS pos FROM l),
      q AS (SELECT *, last_value(pos IGNORE NULLS) {BY} ROWS UNBOUNDED PRECEDING) AS i0, first_value(pos IGNORE NULLS) {BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1,
        last_value(l IGNORE NULLS) {BY} ROWS UNBOUNDED PRECEDING) AS l0, first_value(l IGNORE NULLS) {BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l1 FROM n)
      SELECT permno, date, coalesce(l, {sql}, min(l) OVER (PARTITION BY permno)) AS x FROM q"""

    @query(f"log_replace_{method}", "permno:i date:d x:f6", body)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return X.log_replace(dense(spark, sf), "var", method).withColumnRenamed("log_x", "x")


_log_replace("min", "min(l) OVER (PARTITION BY permno)")
_log_replace("mean", "avg(l) OVER (PARTITION BY permno)")
_log_replace("zero", "0")
_log_replace("ffill", "l0")
_log_replace("interpolate", "CASE WHEN i1 IS NULL THEN l0 ELSE l0 + (l1 - l0) * (i - i0) / nullif(i1 - i0, 0) END")


@query("months_between", "order_key:i months:i", "SELECT o_orderkey AS order_key, 12 * (2001 - year(o_orderdate)) + 6 - month(o_orderdate) AS months FROM orders")
def months_between(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), C.months_between(F.col("o_orderdate"), F.to_date(F.lit("2001-06-30"))).alias("months"))


@query("month_end_step", "order_key:i next:d", "SELECT o_orderkey AS order_key, last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)) AS next FROM orders")
def month_end_step(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), C.month_end(F.col("o_orderdate").cast("date"), 1).alias("next"))


@query("window_bounds", "sampling_date:d start:d stop:d", f"WITH {MONTHLY} SELECT DISTINCT date AS sampling_date, last_day(CAST(date - INTERVAL 12 MONTH AS DATE)) + 1 AS start, last_day(CAST(date + INTERVAL 12 MONTH AS DATE)) AS stop FROM m")
def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    d = T.monthly(spark, sf).select(F.col("date").alias("sampling_date")).distinct()
    return d.withColumn("start", C.back_start(F.col("sampling_date"), 12)).withColumn("stop", C.month_end(F.col("sampling_date"), 12))


@query("parse_date", "order_key:i date:d bad:b", "SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS date, true AS bad FROM orders")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw"))
    return raw.withColumn("date", F.to_date("raw")).withColumn("bad", F.try_to_timestamp(F.concat(F.lit("x"), F.col("raw"))).isNull())


SIC_CASE = " ".join(f"WHEN p_size * 200 BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in C.SIC_DIVISIONS)
FF_VALUES = ", ".join(f"({a}, {b}, '{t}')" for t, _, ranges in C.TWELVE_SECTORS for a, b in ranges)


@query("sic_division", "p:i division:s", f"SELECT p_partkey AS p, CASE {SIC_CASE} ELSE 'N/A' END AS division FROM part")
def sic_division(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("p"), C.sic_division(F.col("p_size") * 200).alias("division"))


@query("ff12_sector", "p:i ff_ticker:s", f"SELECT p_partkey AS p, coalesce(t, 'Other') AS ff_ticker FROM part LEFT JOIN (VALUES {FF_VALUES}) r(a, b, t) ON p_size * 200 + p_partkey % 100 BETWEEN a AND b")
def ff12_sector(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("p"), (F.col("p_size") * 200 + F.col("p_partkey") % 100).alias("code"))
    return C.with_twelve_sectors(p, "code")


@query("gics_sector", "p:i sector:s", "WITH k AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey ELSE CAST(10 + p_partkey % 60 AS VARCHAR) || '1020' END AS gics FROM part), g AS (SELECT CAST(10 + row_number() OVER (ORDER BY t) AS VARCHAR) AS code, t FROM (SELECT DISTINCT p_type AS t FROM part)) SELECT p, CASE WHEN regexp_full_match(gics, '[0-9]+') THEN coalesce(t, 'N/A') ELSE 'N/A' END AS sector FROM k LEFT JOIN g ON code = substr(gics, 1, 2)")
def gics_sector(spark: SparkSession, sf: str) -> DataFrame:
    part = T.table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey"))).otherwise(F.concat((10 + F.col("p_partkey") % 60).cast("string"), F.lit("1020")))
    types = part.select(F.col("p_type").alias("t")).distinct().withColumn("code", (10 + F.row_number().over(Window.orderBy("t"))).cast("string"))  # a code table
    k = part.select(F.col("p_partkey").alias("p"), raw.alias("gics")).withColumn("code", F.substring("gics", 1, 2))
    return k.join(F.broadcast(types), "code", "left").withColumn("sector", F.when(F.col("gics").rlike("^[0-9]+$"), F.coalesce("t", F.lit("N/A"))).otherwise("N/A"))


@query("string_ops", "p:i head:s title:s swapped:s first:s short:s", "SELECT p_partkey AS p, substr(p_brand, 1, 5) AS head, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, replace(p_name, ' ', '&') AS swapped, string_split(p_name, ' ')[1] AS first, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS short FROM part")
def string_ops(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.substring("p_brand", 1, 5).alias("head"), C.title_case(n).alias("title"), F.regexp_replace(n, " ", "&").alias("swapped"), F.split(n, " ")[0].alias("first"), C.initials(n).alias("short"))


@query("name_lookup", "permno:i ticker:s name:s", "SELECT n_nationkey AS permno, n_name AS ticker, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name FROM nation")
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("permno"), F.col("n_name").alias("ticker"), C.title_case(F.col("n_name")).alias("name"))


@query("year_extract", "year:i n:i", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_extract(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("fill_variants", "permno:i date:d by_min:f8 by_mean:f8 by_other:f8", f"WITH {DAILY}, {DENSE} SELECT permno, date, coalesce(var, min(var) OVER (PARTITION BY permno)) AS by_min, coalesce(var, avg(var) OVER (PARTITION BY permno)) AS by_mean, coalesce(var, noisevar, 0) AS by_other FROM g")
def fill_variants(spark: SparkSession, sf: str) -> DataFrame:
    w, v = Window.partitionBy("permno"), F.col("var")
    return dense(spark, sf).select("permno", "date", F.coalesce(v, F.min(v).over(w)).alias("by_min"), F.coalesce(v, F.avg(v).over(w)).alias("by_mean"), F.coalesce(v, "noisevar", F.lit(0.0)).alias("by_other"))


@query("event_window", "permno:i date:d flag:i", f"WITH {DAILY}, {DENSE} SELECT permno, date, coalesce(last_value(nullif(CASE WHEN n > 3 THEN 1 ELSE 0 END, 0) IGNORE NULLS) {BY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0) AS flag FROM g")
def event_window(spark: SparkSession, sf: str) -> DataFrame:
    dummy = F.when(F.col("n") > 3, 1)
    return dense(spark, sf).withColumn("e", dummy).withColumn("flag", F.coalesce(X.ffill("e", X.over_time(), 1), F.lit(0)))


# --- sampling ----------------------------------------------------------------------------

PANEL = f"{MONTHLY}, {SECURITIES}, mm AS (SELECT m.permno, m.date, m.mcap, m.ret, m.vol AS var, m.ret * m.ret AS noisevar, permco, ticker FROM m JOIN sec USING (permno))"
PAST = SAMPLES.replace("s AS (SELECT m.*", "s AS (SELECT mm.*").replace("FROM m, range", "FROM mm, range")
AHEAD = FUTURE.replace("a AS (SELECT m.*", "a AS (SELECT mm.*").replace("FROM m, range", "FROM mm, range")
REPRESENTATIVE = """md AS (SELECT sampling_date, permco, permno, median(var) AS med FROM s GROUP BY 1, 2, 3),
  pick AS (SELECT sampling_date, permno FROM md QUALIFY med = max(med) OVER (PARTITION BY sampling_date, permco)),
  rep AS (SELECT s.* REPLACE (coalesce(sum(mcap) OVER (PARTITION BY sampling_date, date, permco), 0) AS mcap), s.mcap AS permno_mcap FROM s),
  p AS (SELECT rep.* FROM rep SEMI JOIN pick USING (sampling_date, permno))"""
RANKS = ("last_mcap", "mean_mcap", "last_mcap_volatility", "mean_mcap_volatility", "value_vola")
SUMMARY = f"""bd AS (SELECT sampling_date, count(DISTINCT date) AS dates, max(date) AS last FROM p GROUP BY 1),
  bb AS (SELECT p.sampling_date, max(date) AS before FROM p JOIN bd USING (sampling_date) WHERE date < last GROUP BY 1),
  pv AS (SELECT p.*, sqrt(coalesce(var, noisevar)) AS v, dates, last, coalesce(before, last) AS before FROM p JOIN bd USING (sampling_date) LEFT JOIN bb USING (sampling_date)),
  st AS (SELECT sampling_date, permno, arg_max(ticker, date) AS ticker, count(ret) > CAST(0.99 AS DOUBLE) * max(dates) AS has_all_days,
    arg_max(mcap, date) FILTER (WHERE date >= before AND mcap IS NOT NULL) AS last_mcap, avg(mcap) AS mean_mcap,
    arg_max(mcap * v, date) FILTER (WHERE date >= before AND v IS NOT NULL) AS last_mcap_volatility, avg(mcap * v) AS mean_mcap_volatility, avg(mcap) * avg(v) AS value_vola FROM pv GROUP BY 1, 2),
  sn AS (SELECT st.*, x.permno IS NOT NULL AS seen FROM st LEFT JOIN (SELECT DISTINCT sampling_date, permno FROM a) x USING (sampling_date, permno)),
  fl AS (SELECT *, seen OR NOT bool_or(seen) OVER (PARTITION BY sampling_date) AS has_next_obs FROM sn),
  ok AS (SELECT *, {", ".join(f"CASE WHEN has_all_days AND has_next_obs THEN {c} END AS {c}_x" for c in RANKS)} FROM fl),
  su AS (SELECT *, {", ".join(f"CASE WHEN {c}_x IS NOT NULL THEN rank() OVER (PARTITION BY sampling_date ORDER BY {c}_x DESC NULLS LAST) + (count(*) OVER (PARTITION BY sampling_date, {c}_x) - 1) / 2.0 END AS {c}_rank" for c in RANKS)} FROM ok),
  ch AS (SELECT *, row_number() OVER (PARTITION BY sampling_date ORDER BY mean_mcap_rank ASC NULLS LAST, permno) AS asset_order FROM su)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf).join(T.securities(spark, sf).drop("bal"), "permno")
    return m.withColumn("var", F.col("vol")).withColumn("noisevar", F.col("ret") * F.col("ret")).drop("vol", "qty")


def described(spark: SparkSession, sf: str) -> DataFrame:
    return SL.summary(panel(spark, sf), 12)


@query("permco_agg", "sampling_date:d permno:i date:d permno_mcap:f2 mcap:f2", f"WITH {PANEL}, {PAST}, {REPRESENTATIVE} SELECT sampling_date, permno, date, permno_mcap, mcap FROM p")
def permco_agg(spark: SparkSession, sf: str) -> DataFrame:
    return S.representative(P.rolling_samples(S.company_sums(panel(spark, sf)), 12))


@query("mean_mcap_vol", "sampling_date:d permno:i mean_mcap_volatility:f2 last_mcap_volatility:f2", f"WITH {PANEL}, {PAST}, {AHEAD}, {REPRESENTATIVE}, {SUMMARY} SELECT sampling_date, permno, mean_mcap_volatility, last_mcap_volatility FROM su")
def mean_mcap_vol(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf)


@query("value_vola", "sampling_date:d permno:i value_vola:f2", f"WITH {PANEL}, {PAST}, {AHEAD}, {REPRESENTATIVE}, {SUMMARY} SELECT sampling_date, permno, value_vola FROM su")
def value_vola(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf)


@query("selection_summary", "sampling_date:d permno:i ticker:s has_all_days:b has_next_obs:b last_mcap:f2 mean_mcap:f2 " + " ".join(f"{c}_rank:f1" for c in RANKS), f"WITH {PANEL}, {PAST}, {AHEAD}, {REPRESENTATIVE}, {SUMMARY} SELECT * FROM su")
def selection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf)


@query("select_largest", "sampling_date:d permno:i asset_order:i ticker:s", f"WITH {PANEL}, {PAST}, {AHEAD}, {REPRESENTATIVE}, {SUMMARY}, c AS (SELECT * FROM ch WHERE asset_order <= 20) SELECT sampling_date, permno, asset_order, CASE WHEN count(*) OVER (PARTITION BY sampling_date, ticker) > 1 THEN ticker || '.' || chr(CAST(64 + row_number() OVER (PARTITION BY sampling_date, ticker ORDER BY asset_order) AS INTEGER)) ELSE ticker END AS ticker FROM c")
def select_largest(spark: SparkSession, sf: str) -> DataFrame:
    return S.select_largest(described(spark, sf), 20)


@query("sample_panel", "sampling_date:d permno:i date:d leg:s asset_order:i ret:f8", f"WITH {PANEL}, {PAST}, {AHEAD}, {REPRESENTATIVE}, {SUMMARY}, c AS (SELECT sampling_date, permno, asset_order FROM ch WHERE asset_order <= 10) SELECT sampling_date, permno, date, 'historic' AS leg, asset_order, ret FROM p JOIN c USING (sampling_date, permno) UNION ALL SELECT sampling_date, permno, date, 'future', asset_order, ret FROM a JOIN c USING (sampling_date, permno)")
def sample_panel(spark: SparkSession, sf: str) -> DataFrame:
    past, ahead, _ = SL.sample_panel(panel(spark, sf), 12, 10)
    cols = ["sampling_date", "permno", "date", "asset_order", "ret"]
    return past.select(*cols, F.lit("historic").alias("leg")).unionByName(ahead.select(*cols, F.lit("future").alias("leg")))


@query("names_asof", "permno:i comnam:s", f"WITH {NAMES} SELECT permno, comnam FROM nm WHERE DATE '1999-06-30' BETWEEN namedt AND nameendt")
def names_asof(spark: SparkSession, sf: str) -> DataFrame:
    return P.as_of(T.names(spark, sf), F.to_date(F.lit("1999-06-30")))


@query("legacy_selection", "year:i permno:i mean_mcap:f2 rank:i", f"""WITH {MONTHLY}, y AS (SELECT year(date) AS year, permno, count(ret) AS n, avg(mcap) AS mean_mcap FROM m GROUP BY 1, 2), t AS (SELECT year(date) AS year, count(DISTINCT date) AS dates FROM m GROUP BY 1),
  e AS (SELECT y.* FROM y JOIN t USING (year) SEMI JOIN (SELECT year - 1 AS year, permno FROM y) z ON z.year = y.year AND z.permno = y.permno WHERE n = dates)
  SELECT year, permno, mean_mcap, row_number() OVER (PARTITION BY year ORDER BY mean_mcap DESC, permno) AS rank FROM e QUALIFY rank <= 20""")
def legacy_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf).withColumn("year", F.year("date"))
    y = m.groupBy("year", "permno").agg(F.count("ret").alias("n"), F.avg("mcap").alias("mean_mcap"))
    t = m.groupBy("year").agg(F.count_distinct("date").alias("dates"))
    full = y.join(F.broadcast(t), "year").where("n = dates").join(y.select((F.col("year") - 1).alias("year"), "permno"), ["year", "permno"], "left_semi")
    w = Window.partitionBy("year").orderBy(F.desc("mean_mcap"), "permno")
    return full.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


@query("asset_attributes", "permno:i sic:i division:s ff_ticker:s", f"""WITH c AS (SELECT l_suppkey AS permno, arg_max(p_size * 200, (l_shipdate, l_orderkey, l_linenumber)) AS sic FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
  SELECT permno, sic, CASE {SIC_CASE.replace('p_size * 200', 'sic')} ELSE 'N/A' END AS division, coalesce(t, 'Other') AS ff_ticker FROM c LEFT JOIN (VALUES {FF_VALUES}) r(a, b, t) ON sic BETWEEN a AND b""")
def asset_attributes(spark: SparkSession, sf: str) -> DataFrame:
    part = T.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 200).alias("sic"))
    rows = T.table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_suppkey").alias("permno"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("date"), "sic")
    return C.with_twelve_sectors(S.attributes(rows, ["sic"]), "sic").withColumn("division", C.sic_division(F.col("sic")))


# --- indices -----------------------------------------------------------------------------


@query("construct_index", "date:d ew:f8 vw:f8 log_vw:f8", f"WITH {MONTHLY} SELECT date, avg(vol) AS ew, coalesce(sum(vol * mcap), 0) / sum(mcap) AS vw, ln(nullif(coalesce(sum(vol * mcap), 0) / sum(mcap), 0)) AS log_vw FROM m GROUP BY 1")
def construct_index(spark: SparkSession, sf: str) -> DataFrame:
    g = T.monthly(spark, sf).groupBy("date").agg(F.avg("vol").alias("ew"), P.weighted_mean("vol", "mcap").alias("vw"))
    return g.withColumn("log_vw", C.ln(F.col("vw")))


@query("daily_aggregates", "date:d ew_ret:f8 vw_ret:f8 ew_vol:f8 n:i norm_vol:f6", f"""WITH {DAILY}, z AS (SELECT *, sqrt(coalesce(nullif(var, 0), noisevar)) AS v FROM d), n AS (SELECT *, (v - avg(v) OVER (PARTITION BY permno)) / nullif(stddev_samp(v) OVER (PARTITION BY permno), 0) AS nv FROM z)
  SELECT date, avg(ret) AS ew_ret, coalesce(sum(ret * mcap), 0) / sum(mcap) AS vw_ret, avg(v) AS ew_vol, count(ret) AS n, avg(nv) AS norm_vol FROM n GROUP BY 1""")
def daily_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    d = T.daily(spark, sf).withColumn("v", F.sqrt(F.coalesce(F.nullif("var", F.lit(0)), "noisevar")))
    d = d.withColumn("nv", X.zscore(F.col("v"), Window.partitionBy("permno")))
    return d.groupBy("date").agg(F.avg("ret").alias("ew_ret"), P.weighted_mean("ret", "mcap").alias("vw_ret"), F.avg("v").alias("ew_vol"), F.count("ret").alias("n"), F.avg("nv").alias("norm_vol"))


@query("normalized_vola_index", "date:d index:f6", f"WITH {DAILY}, z AS (SELECT *, ln(nullif(sqrt(coalesce(nullif(var, 0), noisevar)), 0)) AS v FROM d) SELECT date, avg(nv) AS index FROM (SELECT *, (v - avg(v) OVER (PARTITION BY permno)) / nullif(stddev_samp(v) OVER (PARTITION BY permno), 0) AS nv FROM z) GROUP BY 1".replace("AS index", 'AS "index"'))
def normalized_vola_index(spark: SparkSession, sf: str) -> DataFrame:
    v = C.ln(F.sqrt(F.coalesce(F.nullif("var", F.lit(0)), "noisevar")))
    d = T.daily(spark, sf).withColumn("v", v)
    return d.withColumn("nv", X.zscore(F.col("v"), Window.partitionBy("permno"))).groupBy("date").agg(F.avg("nv").alias("index"))


@query("daily_index_build", "date:d ew:f8 vw:f8 capped:f4 z:f6 iv:f8", f"""WITH {MONTHLY}, {ROLLED}, c AS (SELECT date, quantile_cont(mcap, 0.99) AS q FROM m GROUP BY 1),
  x AS (SELECT r.*, least(mcap, q) AS cap, (ret - lag(mean, 3) {BY})) / nullif(lag(std, 3) {BY}), 0) AS z, 1 / nullif(lag(std, 3) {BY}), 0) AS v FROM r JOIN c USING (date))
  SELECT date, avg(ret) AS ew, coalesce(sum(ret * mcap), 0) / sum(mcap) AS vw, avg(cap) AS capped, avg(z) AS z, coalesce(sum(ret * v), 0) / nullif(sum(v), 0) AS iv FROM x GROUP BY 1""")
def daily_index_build(spark: SparkSession, sf: str) -> DataFrame:
    w = X.over_time()
    r = rolled(spark, sf)
    caps = r.groupBy("date").agg(F.percentile("mcap", F.lit(0.99)).alias("q"))
    x = r.withColumn("_m", F.lag("mean", 3).over(w)).withColumn("_s", F.lag("std", 3).over(w)).join(caps, "date")
    x = x.withColumn("cap", F.least("mcap", "q")).withColumn("z", C.ratio(F.col("ret") - F.col("_m"), F.col("_s"))).withColumn("v", C.ratio(F.lit(1.0), F.col("_s")))
    return x.groupBy("date").agg(F.avg("ret").alias("ew"), P.weighted_mean("ret", "mcap").alias("vw"), F.avg("cap").alias("capped"), F.avg("z").alias("z"), P.weighted_mean("ret", "v").alias("iv"))


@query("index_stats_horizons", "sampling_date:d horizon:i ret:f8 var:f8", f"""WITH {MONTHLY}, {MARKET}, s AS (SELECT DISTINCT date AS sampling_date FROM f) SELECT sampling_date, h AS horizon, product(1 + mkt) - 1 AS ret, var_samp(mkt) * 252 AS var FROM s, f, {HORIZON_VALUES} v(h)
  WHERE date > sampling_date AND date <= last_day(CAST(sampling_date + to_months(CAST(h AS INTEGER)) AS DATE)) AND last_day(CAST(sampling_date + to_months(CAST(h AS INTEGER)) AS DATE)) <= (SELECT max(date) FROM f) GROUP BY 1, 2""")
def index_stats_horizons(spark: SparkSession, sf: str) -> DataFrame:
    f = T.market(spark, sf)
    ahead = P.forward_samples(f, max(HORIZONS)).join(F.broadcast(f.agg(F.max("date").alias("_max"))))
    return P.horizons(ahead, "sampling_date", "date", HORIZONS, F.col("_max")).groupBy("sampling_date", "horizon").agg(P.compounded("mkt").alias("ret"), (F.var_samp("mkt") * 252).alias("var"))


@query("long_weights", "permno:i date:d weight:f10", f"WITH {MONTHLY} SELECT permno, date, mcap / nullif(sum(mcap) OVER (PARTITION BY date), 0) AS weight FROM m")
def long_weights(spark: SparkSession, sf: str) -> DataFrame:
    return I.long_weights(T.monthly(spark, sf), "mcap")


RESID = "w AS (SELECT permno, date, mcap / sum(mcap) OVER (PARTITION BY date) - 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM m)"
NEXT = "x AS (SELECT m.permno, m.date, coalesce(m.ret, 0) AS ret, weight FROM m JOIN w ON w.permno = m.permno AND m.date = last_day(CAST(w.date + INTERVAL 1 MONTH AS DATE)))"


@query("residual_weights", "permno:i date:d weight:f10 scaled:f10", f"WITH {MONTHLY}, {RESID} SELECT permno, date, weight, 2 * weight / nullif(sum(abs(weight)) OVER (PARTITION BY date), 0) AS scaled FROM w")
def residual_weights(spark: SparkSession, sf: str) -> DataFrame:
    m = I.residual_weights(T.monthly(spark, sf), "mcap")
    return m.withColumn("scaled", C.ratio(2 * F.col("weight"), F.sum(F.abs("weight")).over(Window.partitionBy("date"))))


def weighted_next(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Residual weights by sampling date, and the returns of the month after it."""
    m = T.monthly(spark, sf)
    weights = I.residual_weights(m, "mcap").select(F.col("date").alias("sampling_date"), "permno", "weight")
    return weights, m.select(C.month_end(F.col("date"), -1).alias("sampling_date"), "permno", "date", "ret")


def _index(which: str, where: str) -> None:
    @query(f"index_portfolio_{which}", "date:d ret:f8", f"WITH {MONTHLY}, {RESID}, {NEXT} SELECT date, sum(ret * weight) AS ret FROM x {where} GROUP BY 1")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.index_portfolio(*weighted_next(spark, sf), which)


_index("both", "")
_index("long", "WHERE weight > 0")
_index("short", "WHERE weight < 0")


@query("hedged_index", "date:d ret:f8", f"""WITH {MONTHLY}, {RESID}, {NEXT}, {MARKET}, l AS (SELECT date, sum(ret * weight) AS l FROM x WHERE weight > 0 GROUP BY 1), s AS (SELECT date, sum(ret * weight) AS s FROM x WHERE weight < 0 GROUP BY 1),
  j AS (SELECT date, l, s, mkt FROM l JOIN s USING (date) JOIN f USING (date)), b AS (SELECT regr_slope(l, mkt) AS bl, regr_slope(s, mkt) AS bs FROM j) SELECT date, s - l * bs / nullif(bl, 0) AS ret FROM j, b""")
def hedged_index(spark: SparkSession, sf: str) -> DataFrame:
    w, r = weighted_next(spark, sf)
    return I.hedged(I.index_portfolio(w, r, "long"), I.index_portfolio(w, r, "short"), T.market(spark, sf).select("date", F.col("mkt").alias("factor")))


@query("shock_proxies", "date:d shock_1:f8 shock_2:f8 shock_3:f8", f"WITH {MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mcap DESC NULLS LAST, permno) AS k FROM m) SELECT date, max(CASE WHEN k = 1 THEN ret END) AS shock_1, max(CASE WHEN k = 2 THEN ret END) AS shock_2, max(CASE WHEN k = 3 THEN ret END) AS shock_3 FROM r GROUP BY 1")
def shock_proxies(spark: SparkSession, sf: str) -> DataFrame:
    return I.ranked_asset_returns(T.monthly(spark, sf), "mcap", "ret", [1, 2, 3])


@query("portfolio_sort_hml", "date:d low:f8 high:f8 hml:f8", f"WITH {MONTHLY}, {BUCKETS} SELECT date, avg(CASE WHEN bucket = 1 THEN ret END) AS low, avg(CASE WHEN bucket = 5 THEN ret END) AS high, avg(CASE WHEN bucket = 5 THEN ret END) - avg(CASE WHEN bucket = 1 THEN ret END) AS hml FROM b GROUP BY 1")
def portfolio_sort_hml(spark: SparkSession, sf: str) -> DataFrame:
    return I.high_minus_low(I.sorted_means(T.monthly(spark, sf), "mcap", "ret"), "ret")


@query("double_sort", "date:d bucket1:i bucket2:i ret:f8", f"""WITH {MONTHLY}, b1 AS (SELECT m.*, 1 + len(list_filter(q, lambda x: round(mcap, 10) > round(x, 10))) AS bucket1 FROM m JOIN (SELECT date, quantile_cont(mcap, [0.5]) AS q FROM m GROUP BY 1) USING (date)),
  b2 AS (SELECT b1.*, CASE WHEN vol IS NOT NULL THEN 1 + len(list_filter(q, lambda x: round(vol, 10) > round(x, 10))) END AS bucket2 FROM b1 JOIN (SELECT date, bucket1, quantile_cont(vol, [1/3, 2/3]) AS q FROM b1 GROUP BY 1, 2) USING (date, bucket1)) SELECT date, bucket1, bucket2, avg(ret) AS ret FROM b2 GROUP BY 1, 2, 3""")
def double_sort(spark: SparkSession, sf: str) -> DataFrame:
    return I.double_sort(T.monthly(spark, sf), "mcap", "vol", "ret", 2, 3)


@query("performance_summary", "mean:f8 vol:f8 sharpe:f6 drawdown:f8", f"""WITH {MONTHLY}, {MARKET}, v AS (SELECT date, mkt, product(1 + mkt) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM f), d AS (SELECT *, v / max(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM v)
  SELECT avg(mkt) * 12 AS mean, stddev_samp(mkt) * sqrt(12) AS vol, avg(mkt) * 12 / (stddev_samp(mkt) * sqrt(12)) AS sharpe, min(d) AS drawdown FROM d""")
def performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return I.performance(T.market(spark, sf).withColumnRenamed("mkt", "ret"))


def quarters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Value weights at quarter ends, and the returns of the three months after each."""
    m = T.monthly(spark, sf)
    w = I.long_weights(m.where(F.month("date") % 3 == 0), "mcap").select(F.col("date").alias("sampling_date"), "permno", "weight")
    ahead = m.withColumn("sampling_date", F.last_day(F.add_months(F.trunc("date", "quarter"), -1)))
    return w, ahead.select("sampling_date", "permno", "date", "ret")


QUARTERS = """qw AS (SELECT date AS sampling_date, permno, mcap / sum(mcap) OVER (PARTITION BY date) AS w FROM m WHERE month(date) % 3 = 0),
  qr AS (SELECT permno, date, coalesce(ret, 0) AS ret, last_day(CAST(date_trunc('quarter', date) - INTERVAL 1 MONTH AS DATE)) AS sampling_date FROM m), qh AS (SELECT * FROM qr JOIN qw USING (sampling_date, permno))"""


@query("rebalanced_continuous", "sampling_date:d date:d ret:f8", f"WITH {MONTHLY}, {QUARTERS} SELECT sampling_date, date, sum(ret * w) AS ret FROM qh GROUP BY 1, 2")
def rebalanced_continuous(spark: SparkSession, sf: str) -> DataFrame:
    return I.rebalanced(*quarters(spark, sf))


@query("rebalanced_discrete", "sampling_date:d date:d ret:f8", f"WITH {MONTHLY}, {QUARTERS}, g AS (SELECT *, w * coalesce(product(1 + ret) OVER (PARTITION BY sampling_date, permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS wg FROM qh) SELECT sampling_date, date, sum(ret * wg) / sum(wg) AS ret FROM g GROUP BY 1, 2")
def rebalanced_discrete(spark: SparkSession, sf: str) -> DataFrame:
    return I.rebalanced(*quarters(spark, sf), "discrete")


@query("ranked_shares", "date:d permno:i rank:i share:f8", f"WITH {MONTHLY} SELECT date, permno, row_number() OVER (PARTITION BY date ORDER BY mcap DESC, permno) AS rank, mcap / sum(mcap) OVER (PARTITION BY date) AS share FROM m")
def ranked_shares(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("date")
    return T.monthly(spark, sf).withColumn("rank", F.row_number().over(w.orderBy(F.desc("mcap"), "permno"))).withColumn("share", X.share(F.col("mcap"), w))


@query("log_vola_load", "permno:i date:d log_vol:f6", f"WITH {DAILY}, {DENSE}, {FILLED} SELECT permno, date, x / 2 AS log_vol FROM lf")
def log_vola_load(spark: SparkSession, sf: str) -> DataFrame:
    g = dense(spark, sf).withColumn("v", F.sqrt("var")).withColumn("nv", F.sqrt("noisevar"))
    return X.log_fill(g, "v", "nv").withColumnRenamed("log_x", "log_vol")


@query("returns_load", "permno:i date:d ret:f8 mkt:f8", f"WITH {MONTHLY}, {MARKET} SELECT permno, date, coalesce(ret, 0) AS ret, mkt FROM m LEFT JOIN f USING (date)")
def returns_load(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).join(T.market(spark, sf).select("date", "mkt"), "date", "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


@query("collect_returns", "permno:i sampling_date:d past_ret:f8 past_var:f8 next_ret:f8 next_var:f8", f"""WITH {MONTHLY}, {MARKET}, e AS (SELECT permno, date, ret - rf AS ret FROM m JOIN f USING (date)), {SAMPLES.replace('FROM m, range', 'FROM e m, range')}, {FUTURE.replace('FROM m, range', 'FROM e m, range')},
  p AS (SELECT permno, sampling_date, product(1 + ret) - 1 AS past_ret, var_samp(ret) * 252 AS past_var FROM s GROUP BY 1, 2), n AS (SELECT permno, sampling_date, product(1 + ret) - 1 AS next_ret, var_samp(ret) * 252 AS next_var FROM a GROUP BY 1, 2)
  SELECT * FROM p LEFT JOIN n USING (permno, sampling_date)""")
def collect_returns(spark: SparkSession, sf: str) -> DataFrame:
    e = I.excess_returns(T.monthly(spark, sf), T.market(spark, sf))
    one = lambda df, k: df.groupBy("permno", "sampling_date").agg(P.compounded("ret").alias(f"{k}_ret"), (F.var_samp("ret") * 252).alias(f"{k}_var"))
    return one(P.rolling_samples(e, 12), "past").join(one(P.forward_samples(e, 12), "next"), ["permno", "sampling_date"], "left")
