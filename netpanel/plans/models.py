"""Queries for regressions, vector models, covariances, decompositions and networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import correlation_net as CN
from ..operators import description as DE
from ..operators import effects as FX
from ..operators import instruments as IV
from ..operators import matrices as M
from ..operators import models as E
from ..operators import moments as MO
from ..operators import panel as P
from ..operators import regression as R
from ..operators import spillover as SP
from ..sources import catalog as D
from ..sources import estimates as S
from ..sources import tables as T
from ..sources.tables import MARKET, MONTHLY
from .ordered import BY, REGIONS, regions
from .registry import query
from .relational import HORIZON_VALUES, HORIZONS, SAMPLES

J = "j AS (SELECT m.*, mkt, disp, size, rf FROM m JOIN f USING (date))"


def with_market(spark: SparkSession, sf: str) -> DataFrame:
    return T.monthly(spark, sf).join(F.broadcast(T.market(spark, sf)), "date")


# --- factor models --------------------------------------------------------------------------


@query("capm_ols", "permno:i const:f6 beta:f6 r2:f6 sigma2:f8", f"WITH {MONTHLY}, {MARKET}, {J} SELECT permno, regr_intercept(ret, mkt) AS const, regr_slope(ret, mkt) AS beta, regr_r2(ret, mkt) AS r2, (regr_syy(ret, mkt) - pow(regr_sxy(ret, mkt), 2) / nullif(regr_sxx(ret, mkt), 0)) / nullif(count(ret) - 2, 0) AS sigma2 FROM j GROUP BY 1")
def capm_ols(spark: SparkSession, sf: str) -> DataFrame:
    return R.one_factor(with_market(spark, sf), "ret", "mkt", ["permno"])


# two regressors in closed form, from sums
TWO = """g AS (SELECT permno, count(*) AS n, avg(ret) AS y, avg(mkt) AS a, avg(disp) AS b, covar_pop(mkt, mkt) AS aa, covar_pop(disp, disp) AS bb, covar_pop(mkt, disp) AS ab, covar_pop(ret, mkt) AS ya, covar_pop(ret, disp) AS yb, covar_pop(ret, ret) AS yy FROM j GROUP BY 1),
  c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS b_mkt, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b_disp FROM g)"""


@query("ff3_ols", "permno:i const:f5 b_mkt:f5 b_disp:f5 r2:f5", f"WITH {MONTHLY}, {MARKET}, {J}, {TWO} SELECT permno, y - b_mkt * a - b_disp * b AS const, b_mkt, b_disp, (b_mkt * ya + b_disp * yb) / yy AS r2 FROM c")
def ff3_ols(spark: SparkSession, sf: str) -> DataFrame:
    return R.ols(with_market(spark, sf), "ret", ["mkt", "disp"], ["permno"])


@query("factor_pred_errors", "permno:i date:d err:f6 err_noconst:f6", f"WITH {MONTHLY}, {MARKET}, {J}, b AS (SELECT permno, regr_intercept(ret, mkt) AS const, regr_slope(ret, mkt) AS beta FROM j WHERE date <= DATE '1999-12-31' GROUP BY 1) SELECT permno, date, ret - const - beta * mkt AS err, ret - beta * mkt AS err_noconst FROM j JOIN b USING (permno) WHERE date > DATE '1999-12-31'")
def factor_pred_errors(spark: SparkSession, sf: str) -> DataFrame:
    j = with_market(spark, sf)
    b = R.one_factor(P.date_slice(j, end="1999-12-31"), "ret", "mkt", ["permno"]).select("permno", "const", "beta")
    ahead = j.where("date > date'1999-12-31'").join(b, "permno")
    return ahead.withColumn("err_noconst", F.col("ret") - F.col("beta") * F.col("mkt")).withColumn("err", F.col("err_noconst") - F.col("const"))


@query("variance_decomp", "permno:i systematic:f8 idiosyncratic:f8", f"WITH {MONTHLY}, {MARKET}, {J}, b AS (SELECT permno, pow(regr_slope(ret, mkt), 2) AS b2, var_samp(ret) AS tot, var_samp(mkt) AS vm FROM j GROUP BY 1) SELECT permno, vm * b2 AS systematic, CASE WHEN tot - vm * b2 > 0 THEN tot - vm * b2 END AS idiosyncratic FROM b")
def variance_decomp(spark: SparkSession, sf: str) -> DataFrame:
    g = with_market(spark, sf).groupBy("permno").agg((F.var_samp("mkt") * F.pow(F.regr_slope("ret", "mkt"), 2)).alias("systematic"), F.var_samp("ret").alias("tot"))
    rest = F.col("tot") - F.col("systematic")
    return g.withColumn("idiosyncratic", F.when(rest > 0, rest))


@query("forward_betas", "permno:i horizon:i beta:f5", f"WITH {MONTHLY}, {MARKET}, {J} SELECT permno, h AS horizon, regr_slope(ret, mkt) AS beta FROM j, {HORIZON_VALUES} v(h) WHERE date > DATE '1998-12-31' AND date <= last_day(CAST(DATE '1998-12-31' + to_months(CAST(h AS INTEGER)) AS DATE)) GROUP BY 1, 2")
def forward_betas(spark: SparkSession, sf: str) -> DataFrame:
    j = with_market(spark, sf).withColumn("sampling_date", F.to_date(F.lit("1998-12-31")))
    return R.one_factor(P.horizons(j, "sampling_date", "date", HORIZONS, F.to_date(F.lit("2099-12-31"))), "ret", "mkt", ["permno", "horizon"])


@query("cross_section_ols", "slope:f5 const:f6", f"WITH {MONTHLY}, {MARKET}, {J}, b AS (SELECT permno, regr_slope(ret, mkt) AS beta, avg(ret) AS mean FROM j GROUP BY 1) SELECT regr_slope(mean, beta) AS slope, regr_intercept(mean, beta) AS const FROM b")
def cross_section_ols(spark: SparkSession, sf: str) -> DataFrame:
    b = with_market(spark, sf).groupBy("permno").agg(F.regr_slope("ret", "mkt").alias("beta"), F.avg("ret").alias("mean"))
    return b.agg(F.regr_slope("mean", "beta").alias("slope"), F.regr_intercept("mean", "beta").alias("const"))


@query("hac_mean_tstat", "mean:f8 se:f8 tstat:f4", f"""WITH {MONTHLY}, {MARKET}, r AS (SELECT row_number() OVER (ORDER BY date) AS k, mkt AS x FROM f), s AS (SELECT avg(x) AS mean, count(*) AS t, CAST(round(pow(count(*), 0.25)) AS INTEGER) AS lags FROM r),
  u AS (SELECT k, x - mean AS u FROM r, s), v AS (SELECT sum(a.u * b.u * CASE WHEN a.k = b.k THEN 1.0 ELSE 2 * (1 - (a.k - b.k) / CAST(lags + 1 AS DOUBLE)) END) AS v FROM u a, u b, s WHERE a.k - b.k BETWEEN 0 AND lags)
  SELECT mean, sqrt(v) / t AS se, mean / (sqrt(v) / t) AS tstat FROM s, v""")
def hac_mean_tstat(spark: SparkSession, sf: str) -> DataFrame:
    return R.hac_mean(T.market(spark, sf), "mkt", "date")


@query("significance_stars", "date:d stars:s", f"WITH {MONTHLY}, t AS (SELECT date, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) - 5 AS t FROM m GROUP BY 1) SELECT date, CASE WHEN abs(t) > 2.58 THEN '***' WHEN abs(t) > 1.96 THEN '**' WHEN abs(t) > 1.645 THEN '*' ELSE '' END AS stars FROM t")
def significance_stars(spark: SparkSession, sf: str) -> DataFrame:
    t = T.monthly(spark, sf).groupBy("date").agg((F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("ret"))) - 5).alias("t"))
    return t.withColumn("stars", R.stars(F.col("t")))


# a coefficient's error is a sum over dates, v; its variance adds the lagged products of v
@query("hac_ols", "permno:i term:s coef:f6 se:f8 tstat:f4", f"""WITH {MONTHLY}, {MARKET}, {J}, r AS (SELECT permno, ret, mkt, row_number() {BY}) AS k FROM j WHERE ret IS NOT NULL AND mkt IS NOT NULL),
  s AS (SELECT permno, count(*) AS n, avg(mkt) AS mean, regr_sxx(ret, mkt) AS sxx, regr_slope(ret, mkt) AS b, regr_intercept(ret, mkt) AS a, CAST(round(pow(count(*), 0.25)) AS INTEGER) AS lags FROM r GROUP BY 1 HAVING count(*) > 2),
  e AS (SELECT permno, k, n, lags, mean, a, b, ret - a - b * mkt AS e, (mkt - mean) * (ret - a - b * mkt) / sxx AS v FROM r JOIN s USING (permno)),
  t AS (SELECT permno, k, lags, 'const' AS term, a AS coef, e / n - mean * v AS v FROM e UNION ALL SELECT permno, k, lags, 'mkt', b, v FROM e),
  q AS (SELECT x.permno, x.term, any_value(x.coef) AS coef, sqrt(sum(x.v * y.v * CASE WHEN x.k = y.k THEN 1.0 ELSE 2 * (1 - (x.k - y.k) / CAST(x.lags + 1 AS DOUBLE)) END)) AS se
    FROM t x JOIN t y ON x.permno = y.permno AND x.term = y.term AND x.k - y.k BETWEEN 0 AND x.lags GROUP BY 1, 2)
  SELECT permno, term, coef, se, coef / se AS tstat FROM q""")
def hac_ols(spark: SparkSession, sf: str) -> DataFrame:
    return R.hac_ols(with_market(spark, sf), "ret", ["mkt"], "date", "permno")


@query("panel_fe_ols", "effects:s beta:f8 n:i", f"""WITH {MONTHLY}, l AS (SELECT permno, date, ret, lag(vol) {BY}) AS vol FROM m), c AS (SELECT * FROM l WHERE vol IS NOT NULL AND ret IS NOT NULL),
  e AS (SELECT vol - avg(vol) OVER (PARTITION BY permno) AS x, ret - avg(ret) OVER (PARTITION BY permno) AS y FROM c), t AS (SELECT vol - avg(vol) OVER (PARTITION BY date) AS x, ret - avg(ret) OVER (PARTITION BY date) AS y FROM c)
  SELECT 'none' AS effects, regr_slope(ret, vol) AS beta, count(*) AS n FROM c UNION ALL SELECT 'entity', sum(x * y) / sum(x * x), count(*) FROM e UNION ALL SELECT 'time', sum(x * y) / sum(x * x), count(*) FROM t""")
def panel_fe_ols(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf)
    parts = [R.panel_ols(m, "ret", "vol", k, lag=1).withColumn("effects", F.lit(k)) for k in ("none", "entity", "time")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# scores of each kind of effects by date, and three lags of them with Bartlett weights
@query("panel_kernel_errors", "effects:s beta:f8 se:f8 tstat:f4 n:i", f"""WITH {MONTHLY}, l AS (SELECT permno, date, ret, lag(vol) {BY}) AS vol FROM m), c AS (SELECT * FROM l WHERE vol IS NOT NULL AND ret IS NOT NULL),
  o AS (SELECT 'none' AS effects, date, vol - avg(vol) OVER () AS x, ret - avg(ret) OVER () AS y FROM c UNION ALL SELECT 'entity', date, vol - avg(vol) OVER (PARTITION BY permno), ret - avg(ret) OVER (PARTITION BY permno) FROM c
    UNION ALL SELECT 'time', date, vol - avg(vol) OVER (PARTITION BY date), ret - avg(ret) OVER (PARTITION BY date) FROM c),
  b AS (SELECT effects, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n FROM o GROUP BY 1),
  h AS (SELECT effects, date, sum(x * (y - beta * x)) AS h FROM o JOIN b USING (effects) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY effects ORDER BY date) AS k FROM h),
  s AS (SELECT u.effects, sum(u.h * v.h * CASE WHEN u.k = v.k THEN 1.0 ELSE 2 * (1 - (u.k - v.k) / CAST(4 AS DOUBLE)) END) AS s FROM k u JOIN k v ON u.effects = v.effects AND u.k - v.k BETWEEN 0 AND 3 GROUP BY 1)
  SELECT effects, beta, sqrt(s) / xx AS se, beta / (sqrt(s) / xx) AS tstat, n FROM b JOIN s USING (effects)""")
def panel_kernel_errors(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf)
    parts = [R.panel_errors(m, "ret", "vol", k, lag=1).withColumn("effects", F.lit(k)) for k in ("none", "entity", "time")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# the panel has holes: forty rounds of entity and time means, which the effects' own equations replace in Spark
@query("panel_two_way", "term:s beta:f8 se:f8 tstat:f4 n:i", f"""WITH RECURSIVE {MONTHLY}, l AS (SELECT permno, date, ret, lag(vol) {BY}) AS vol FROM m),
  it AS (SELECT 0 AS k, permno, date, vol AS x, ret AS y FROM l WHERE vol IS NOT NULL AND ret IS NOT NULL
    UNION ALL SELECT k + 1, permno, date, x - avg(x) OVER (PARTITION BY date), y - avg(y) OVER (PARTITION BY date) FROM (SELECT k, permno, date, x - avg(x) OVER (PARTITION BY permno) AS x, y - avg(y) OVER (PARTITION BY permno) AS y FROM it WHERE k < 40)),
  o AS (SELECT * FROM it WHERE k = 40), b AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n FROM o),
  h AS (SELECT date, sum(x * (y - beta * x)) AS h, row_number() OVER (ORDER BY date) AS i FROM o, b GROUP BY 1),
  s AS (SELECT sum(u.h * v.h * CASE WHEN u.i = v.i THEN 1.0 ELSE 2 * (1 - (u.i - v.i) / CAST(4 AS DOUBLE)) END) AS s FROM h u JOIN h v ON u.i - v.i BETWEEN 0 AND 3)
  SELECT 'vol' AS term, beta, sqrt(s) / xx AS se, beta / (sqrt(s) / xx) AS tstat, n FROM b, s""")
def panel_two_way(spark: SparkSession, sf: str) -> DataFrame:
    m = T.monthly(spark, sf).withColumn("vol", F.lag("vol").over(Window.partitionBy("permno").orderBy("date")))
    return FX.two_way_fit(m, "ret", ["vol"])


@query("grs_test", "stat:f4 p:f6")
def grs_test(spark: SparkSession, sf: str) -> DataFrame:
    r = regions(spark, sf).groupBy("date").agg(F.avg("x").alias("mkt"))
    v = regions(spark, sf)
    last = v.agg(F.max("permno").alias("_last"))  # the factor is the mean of all series, so one of them depends on the others
    df = v.join(F.broadcast(last)).where("permno < _last").drop("_last").join(r, "date").withColumn("all", F.lit(1))
    return E.grs(df, "all", ("mkt",))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled 64-dimensional vectors, a row a component: permno is the component, date the vector."""
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("date"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "x"))
    return e.select("date", "label", F.col("p").cast("long").alias("permno"), F.col("x").cast("double").alias("x"))


@query("pca_factors", "vec:i pc:i score:f5")
def pca_factors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centre = e.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.c).alias("m"))
    own = e.join(F.broadcast(centre)).select("vec_id", array_to_vector(F.zip_with("v", "m", lambda a, b: a - b)).alias("own"))
    model = PCA(k=3, inputCol="own", outputCol="pcs").fit(own)
    signs = [float(np.sign(c[np.abs(c).argmax()])) for c in model.pc.toArray().T]
    scores = model.transform(own).select("vec_id", F.posexplode(vector_to_array("pcs")).alias("pc", "s"))
    return scores.select(F.col("vec_id").alias("vec"), "pc", (F.col("s") * F.element_at(F.array(*map(F.lit, signs)), F.col("pc") + 1)).alias("score"))


# --- vector autoregressions ------------------------------------------------------------------


@query("var_design_lags", "permno:i date:d x:f6 lag1:f6 lag2:f6", f"WITH {REGIONS} SELECT permno, date, x, lag(x) {BY}) AS lag1, lag(x, 2) {BY}) AS lag2 FROM v")
def var_design_lags(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("permno").orderBy("date")
    return regions(spark, sf).withColumn("lag1", F.lag("x").over(w)).withColumn("lag2", F.lag("x", 2).over(w))


@query("cv_folds", "date:d fold:i", f"""WITH {REGIONS}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM v)),
  f AS (SELECT i AS fold, (n // 12) + CASE WHEN i < n % 12 THEN 1 ELSE 0 END AS len FROM range(0, 12) r(i), (SELECT max(n) AS n FROM t)), c AS (SELECT fold, sum(len) OVER (ORDER BY fold DESC ROWS UNBOUNDED PRECEDING) AS stop, len FROM f)
  SELECT date, fold FROM t JOIN c ON k < stop AND k >= stop - len""")
def cv_folds(spark: SparkSession, sf: str) -> DataFrame:
    dates = regions(spark, sf).select("date").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    t = dates.withColumn("n", n).withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    # folds from the last label down: first the long ones' complement, by position
    length, rest = F.floor(F.col("n") / 12), F.col("n") % 12
    short = (12 - rest) * length  # rows in folds 11 ... rest, each of the plain length
    fold = F.when(F.col("k") < short, 11 - F.floor(F.col("k") / length)).otherwise(rest - 1 - F.floor((F.col("k") - short) / (length + 1)))
    return t.withColumn("fold", fold)


def rolling(spark: SparkSession, sf: str, months: int = 36) -> DataFrame:
    """Windows of the regional panel: sampling_date, date, permno, x, and the mean over regions."""
    v = regions(spark, sf).persist()  # a row a region and month; windows are read in several ways, the tables once
    m = v.groupBy("date").agg(F.avg("x").alias("mkt"))
    return P.rolling_samples(v.join(m, "date"), months)


# the first-order model of all series in SQL: centred regressors (the lags and, with a factor, the
# mean over series as id -1), their cross products, and Gauss-Jordan elimination on them
GAUSS_JORDAN = """m0 AS (SELECT list(r ORDER BY i) AS m, list(i ORDER BY i) AS ids FROM aug),
  gj AS (SELECT 0 AS k, m, ids FROM m0 UNION ALL SELECT k + 1, list_transform(range(1, len(ids) + 1), lambda o: CASE WHEN o = k + 1 THEN list_transform(m[o], lambda y: y / m[o][k + 1])
    ELSE list_transform(range(1, len(m[1]) + 1), lambda c: m[o][c] - m[o][k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END), ids FROM gj WHERE k < len(ids)),
  sol AS (SELECT m, ids FROM gj WHERE k = len(ids))"""


def fit_sql(factor: bool) -> str:
    """bb: source (-1: the factor), equation, coef; kk: permno, date, x, its mean c, and its centred lag part vp and factor part fp."""
    mean = "UNION ALL SELECT -1, date, f - avg(f) OVER () FROM (SELECT date, avg(x) AS f FROM cu GROUP BY 1)" if factor else ""
    return f"""lg AS (SELECT permno, date, x, lag(x) {BY}) AS p FROM v),
  cu AS (SELECT permno, date, x, avg(x) OVER (PARTITION BY permno) AS c, p - avg(p) OVER (PARTITION BY permno) AS pc FROM lg WHERE p IS NOT NULL),
  cz AS (SELECT permno AS id, date, pc AS z FROM cu {mean}),
  aug AS (SELECT i, list(w ORDER BY kind, j) AS r FROM (SELECT x.id AS i, 0 AS kind, y.id AS j, sum(x.z * y.z) AS w FROM cz x JOIN cz y USING (date) GROUP BY 1, 2, 3
    UNION ALL SELECT x.id, 1, y.permno, sum(x.z * (y.x - y.c)) FROM cz x JOIN cu y USING (date) GROUP BY 1, 2, 3) GROUP BY 1),
  {GAUSS_JORDAN}, eqs AS (SELECT list(permno ORDER BY permno) AS e FROM (SELECT DISTINCT permno FROM cu)),
  bb AS (SELECT ids[f] AS source, e[g] AS equation, m[f][len(ids) + g] AS coef FROM sol, eqs, range(1, 200) q(f), range(1, 200) w(g) WHERE f <= len(ids) AND g <= len(e)),
  kk AS (SELECT permno, cu.date, any_value(x) AS x, any_value(c) AS c, sum(CASE WHEN source >= 0 THEN coef * z ELSE 0 END) AS vp, sum(CASE WHEN source < 0 THEN coef * z ELSE 0 END) AS fp
    FROM cu JOIN bb ON equation = permno JOIN cz ON cz.id = source AND cz.date = cu.date GROUP BY 1, 2)"""


# the elimination of every window at once
WINDOW_JORDAN = GAUSS_JORDAN.replace("m0 AS (SELECT list", "m0 AS (SELECT sampling_date, list").replace("FROM aug)", "FROM aug GROUP BY 1)").replace("gj AS (SELECT 0 AS k", "gj AS (SELECT sampling_date, 0 AS k").replace("UNION ALL SELECT k + 1", "UNION ALL SELECT sampling_date, k + 1").replace("sol AS (SELECT m", "sol AS (SELECT sampling_date, m")


def window_fit_sql() -> str:
    """The same of every window of 36 months: wb (window, source, equation, coef) and wm (window, series, its mean, its lag's)."""
    windows = SAMPLES.replace("m.*", "v.*").replace("FROM m", "FROM v").replace("range(0, 12)", "range(0, 36)")
    return f"""{windows}, n AS (SELECT sampling_date, count(DISTINCT permno) AS n FROM s GROUP BY 1), full_dates AS (SELECT sampling_date, date FROM s JOIN n USING (sampling_date) GROUP BY 1, 2, n HAVING count(x) = n),
  enough AS (SELECT sampling_date FROM full_dates JOIN n USING (sampling_date) GROUP BY 1, n HAVING count(*) >= 8 AND count(*) - 1 > n + 1),
  lg AS (SELECT sampling_date, permno, date, x, lag(x) OVER (PARTITION BY sampling_date, permno ORDER BY date) AS p FROM s SEMI JOIN full_dates USING (sampling_date, date) SEMI JOIN enough USING (sampling_date)),
  wm AS (SELECT sampling_date, permno, avg(x) AS c, avg(p) AS pm FROM lg WHERE p IS NOT NULL GROUP BY 1, 2), cu AS (SELECT sampling_date, permno, date, x - c AS y, p - pm AS z FROM lg JOIN wm USING (sampling_date, permno) WHERE p IS NOT NULL),
  aug AS (SELECT sampling_date, i, list(w ORDER BY kind, j) AS r FROM (SELECT a.sampling_date, a.permno AS i, 0 AS kind, b.permno AS j, sum(a.z * b.z) AS w FROM cu a JOIN cu b USING (sampling_date, date) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT a.sampling_date, a.permno, 1, b.permno, sum(a.z * b.y) FROM cu a JOIN cu b USING (sampling_date, date) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
  {WINDOW_JORDAN}, wb AS (SELECT sampling_date, ids[f] AS source, ids[g] AS equation, m[f][len(ids) + g] AS coef FROM sol, range(1, 200) q(f), range(1, 200) w(g) WHERE f <= len(ids) AND g <= len(ids))"""


@query("var_ols", "sampling_date:d equation:i term:s source:i coef:f5", f"""WITH RECURSIVE {REGIONS}, {window_fit_sql()} SELECT sampling_date, equation, 'lag1' AS term, source, coef FROM wb
  UNION ALL SELECT sampling_date, equation, 'const', -1, any_value(e.c) - sum(coef * o.pm) FROM wb JOIN wm e USING (sampling_date) JOIN wm o USING (sampling_date) WHERE e.permno = equation AND o.permno = source GROUP BY 1, 2""")
def var_ols(spark: SparkSession, sf: str) -> DataFrame:
    return E.var_ols(rolling(spark, sf), "sampling_date")


VAR = f"{fit_sql(False)}, r AS (SELECT permno, date, x, c + vp AS fitted, x - c - vp AS resid FROM kk)"
FACTOR_VAR = fit_sql(True)


def whole(spark: SparkSession, sf: str) -> DataFrame:
    """The regional panel as one window, with the mean over regions as factor."""
    v = regions(spark, sf)
    return v.join(v.groupBy("date").agg(F.avg("x").alias("mkt")), "date").withColumn("all", F.lit(1))


def fitted_var(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(panel, coefficients) of the first-order model of all series."""
    v = whole(spark, sf)
    return v, E.var_ols(v, "all")


@query("var_residuals", "permno:i date:d fitted:f6 resid:f6", f"WITH RECURSIVE {REGIONS}, {VAR} SELECT permno, date, fitted, resid FROM r")
def var_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return E.residual_rows(*fitted_var(spark, sf), "all")


@query("mse_score", "neg_mse:f8", f"WITH RECURSIVE {REGIONS}, {VAR} SELECT -avg(pow(resid, 2)) AS neg_mse FROM r")
def mse_score(spark: SparkSession, sf: str) -> DataFrame:
    return var_residuals(spark, sf).agg((-F.avg(F.pow("resid", 2))).alias("neg_mse"))


def _variation(res: DataFrame) -> DataFrame:
    level = F.avg("actual").over(Window.partitionBy("permno"))
    own = res.withColumn("d2", F.pow(F.col("actual") - level, 2))
    return own.groupBy("permno").agg(F.sum("d2").alias("tss"), F.sum(F.pow("resid", 2)).alias("rss"), F.var_samp("actual").alias("var"))


@query("var_r2", "equal:f6 variance:f6", f"WITH RECURSIVE {REGIONS}, {VAR}, s AS (SELECT permno, sum(pow(resid, 2)) AS rss, var_samp(x) AS var, var_samp(x) * (count(*) - 1) AS tss FROM r GROUP BY 1) SELECT 1 - sum(rss) / sum(tss) AS equal, 1 - sum(rss / var) / sum(tss / var) AS variance FROM s")
def var_r2(spark: SparkSession, sf: str) -> DataFrame:
    s = _variation(var_residuals(spark, sf))
    return s.agg((1 - F.sum("rss") / F.sum("tss")).alias("equal"), (1 - F.sum(F.col("rss") / F.col("var")) / F.sum(F.col("tss") / F.col("var"))).alias("variance"))


@query("granular_r2", "permno:i r2:f6", f"WITH RECURSIVE {REGIONS}, {VAR} SELECT permno, 1 - sum(pow(resid, 2)) / (var_samp(x) * (count(*) - 1)) AS r2 FROM r GROUP BY 1")
def granular_r2(spark: SparkSession, sf: str) -> DataFrame:
    return _variation(var_residuals(spark, sf)).withColumn("r2", 1 - F.col("rss") / F.col("tss"))


def factor_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the fitted model with one factor and all lags: permno, date, x, its mean c, vp (lag
    part) and fp (factor part), both centred."""
    v = whole(spark, sf)
    coefs = E.var_ols(v, "all", factors=("mkt",))
    lag = v.select(F.col("permno").alias("source"), F.lead("date").over(Window.partitionBy("permno").orderBy("date")).alias("date"), F.col("x").alias("p")).where("date is not null")
    lags = lag.join(F.broadcast(coefs.where("term = 'lag1'")), "source").groupBy(F.col("equation").alias("permno"), "date").agg(F.sum(F.col("coef") * F.col("p")).alias("vp"))
    loads = coefs.where("term = 'mkt'").select(F.col("equation").alias("permno"), F.col("coef").alias("g"))
    both = v.join(lags, ["permno", "date"]).join(F.broadcast(loads), "permno").withColumn("fp", F.col("g") * F.col("mkt"))
    own = Window.partitionBy("permno")
    return both.select("permno", "date", "x", F.avg("x").over(own).alias("c"), *((F.col(c) - F.avg(c).over(own)).alias(c) for c in ("vp", "fp")))


def sum_of_squares(resid: F.Column) -> F.Column:
    """Of demeaned residuals, by series."""
    return F.var_pop(resid) * F.count(resid)


@query("partial_r2", "factors:f6 var:f6", f"WITH RECURSIVE {REGIONS}, {FACTOR_VAR}, s AS (SELECT permno, var_pop(x - c - vp - fp) * count(*) AS f, var_pop(x - c - vp) * count(*) AS nf, var_pop(x - c - fp) * count(*) AS nv FROM kk GROUP BY 1) SELECT 1 - sum(f) / sum(nf) AS factors, 1 - sum(f) / sum(nv) AS var FROM s")
def partial_r2(spark: SparkSession, sf: str) -> DataFrame:
    base = F.col("x") - F.col("c")
    s = factor_parts(spark, sf).groupBy("permno").agg(sum_of_squares(base - F.col("vp") - F.col("fp")).alias("full"), sum_of_squares(base - F.col("vp")).alias("no_f"), sum_of_squares(base - F.col("fp")).alias("no_v"))
    return s.agg((1 - F.sum("full") / F.sum("no_f")).alias("factors"), (1 - F.sum("full") / F.sum("no_v")).alias("var"))


@query("component_r2", "factors:f6 var:f6", f"WITH RECURSIVE {REGIONS}, {FACTOR_VAR}, s AS (SELECT permno, var_pop(x) * count(*) AS t, var_pop(x - c - vp) * count(*) AS v, var_pop(x - c - fp) * count(*) AS f FROM kk GROUP BY 1) SELECT 1 - sum(f) / sum(t) AS factors, 1 - sum(v) / sum(t) AS var FROM s")
def component_r2(spark: SparkSession, sf: str) -> DataFrame:
    base = F.col("x") - F.col("c")
    s = factor_parts(spark, sf).groupBy("permno").agg(sum_of_squares(F.col("x")).alias("t"), sum_of_squares(base - F.col("vp")).alias("v"), sum_of_squares(base - F.col("fp")).alias("f"))
    return s.agg((1 - F.sum("f") / F.sum("t")).alias("factors"), (1 - F.sum("v") / F.sum("t")).alias("var"))


@query("factor_residuals", "permno:i date:d resid:f6 systematic:f8", f"WITH RECURSIVE {REGIONS}, {FACTOR_VAR} SELECT permno, date, x - c - fp AS resid, var_samp(fp) OVER (PARTITION BY permno) AS systematic FROM kk")
def factor_residuals(spark: SparkSession, sf: str) -> DataFrame:
    k = factor_parts(spark, sf)
    return k.withColumn("resid", F.col("x") - F.col("c") - F.col("fp")).withColumn("systematic", F.var_samp("fp").over(Window.partitionBy("permno")))


@query("var_scale", "permno:i date:d z:f6 back:f6", f"WITH {REGIONS} SELECT permno, date, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z, x AS back FROM v WINDOW w AS (PARTITION BY permno)")
def var_scale(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("permno")
    z = regions(spark, sf).withColumn("m", F.avg("x").over(w)).withColumn("s", F.stddev_samp("x").over(w)).withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
    return z.withColumn("back", F.col("z") * F.col("s") + F.col("m"))


@query("penalty_mask", "equation:i source:i weight:f2", f"WITH {REGIONS}, n AS (SELECT DISTINCT permno FROM v) SELECT a.permno AS equation, b.permno AS source, CASE WHEN a.permno = b.permno THEN 0 ELSE 1 END AS weight FROM n a, n b")
def penalty_mask(spark: SparkSession, sf: str) -> DataFrame:
    n = regions(spark, sf).select(F.col("permno").alias("equation")).distinct()
    return n.crossJoin(n.select(F.col("equation").alias("source"))).withColumn("weight", F.when(F.col("equation") == F.col("source"), 0.0).otherwise(1.0))


@query("coef_density", "sampling_date:d density:f6 sparsity:f6 n_used:i")
def coef_density(spark: SparkSession, sf: str) -> DataFrame:
    lags = elastic_net(spark, sf).where("term like 'lag%'").groupBy("sampling_date")
    used, n = F.count_if(F.col("coef") != 0), F.count(F.lit(1))
    return lags.agg((used / n).alias("density"), (1 - used / n).alias("sparsity"), used.alias("n_used"))


# the grids of the production runs (fixed values)
VAR_GRID = {"alpha": np.geomspace(1e-4, 1e0, 13).tolist(), "lambdau": np.geomspace(1e-2, 1e1, 13).tolist()}
COV_GRID = np.geomspace(1e-3, 1e0, 50).tolist()
SIGMA_GRID = np.geomspace(1e-6, 1e-2, 50).tolist()


@query("elastic_net", "sampling_date:d equation:i term:s source:i coef:f5")
def elastic_net(spark: SparkSession, sf: str) -> DataFrame:
    w = rolling(spark, sf)
    points = w.select("sampling_date").distinct().withColumn("alpha", F.lit(0.5)).withColumn("lambdau", F.lit(0.05))
    return E.penalised_var(w, points, "sampling_date")


@query("elastic_net_two_lags", "sampling_date:d equation:i term:s source:i coef:f5")
def elastic_net_two_lags(spark: SparkSession, sf: str) -> DataFrame:
    w = rolling(spark, sf)
    points = w.select("sampling_date").distinct().withColumn("alpha", F.lit(0.5)).withColumn("lambdau", F.lit(0.05))
    return E.penalised_var(w, points, "sampling_date", free_diagonal=True, factors=("mkt",), lags=2)


@query("elastic_net_cv", "sampling_date:d alpha:f6 lambdau:f6 mse:f5")
def elastic_net_cv(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_point(E.penalised_path(rolling(spark, sf), R.grid(spark, VAR_GRID), "sampling_date"), "sampling_date")


@query("cv_surface", "alpha:f6 lambdau:f6 mse:f5 n:i")
def cv_surface(spark: SparkSession, sf: str) -> DataFrame:
    w = rolling(spark, sf)
    scores = E.penalised_path(w, R.grid(spark, VAR_GRID), "sampling_date", first=E.first_points(w, "sampling_date"))
    return scores.groupBy("alpha", "lambdau").agg(F.avg("mse").alias("mse"), F.count(F.lit(1)).alias("n"))


@query("adaptive_weights", "sampling_date:d equation:i source:i weight:f4")
def adaptive_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = rolling(spark, sf)
    return E.adaptive_weights(w, E.first_points(w, "sampling_date"), "sampling_date")


@query("adaptive_elastic_net_cv", "sampling_date:d equation:i term:s source:i coef:f4")
def adaptive_elastic_net_cv(spark: SparkSession, sf: str) -> DataFrame:
    w = rolling(spark, sf)
    first = E.first_points(w, "sampling_date")
    best = E.best_point(E.penalised_path(w, R.grid(spark, VAR_GRID), "sampling_date", first=first), "sampling_date")
    return E.penalised_var(w, best, "sampling_date", first)


# --- covariances ------------------------------------------------------------------------------


@query("glasso", "sampling_date:d i:i j:i v:f5")
def glasso(spark: SparkSession, sf: str) -> DataFrame:
    return glasso_pairs(spark, sf).select("sampling_date", "i", "j", F.col("cov").alias("v"))


@query("glasso_cv", "sampling_date:d i:i j:i v:f5")
def glasso_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = MO.on_complete_days(rolling(spark, sf), "sampling_date")
    return E.lasso_search(rows.where("dates >= 8"), "sampling_date", COV_GRID).withColumnRenamed("cov", "v")


@query("estimate_sigma", "sampling_date:d i:i j:i v:f5")
def estimate_sigma(spark: SparkSession, sf: str) -> DataFrame:
    rows = MO.on_complete_days(rolling(spark, sf), "sampling_date").where("dates >= 8")
    step = F.col("x") - F.lag("x").over(Window.partitionBy("sampling_date", "permno").orderBy("pos"))
    steps = rows.withColumn("x", step).where("pos > 0").select("sampling_date", (F.col("pos") - 1).alias("pos"), (F.col("dates") - 1).alias("dates"), "permno", "x")
    return E.lasso_search(steps, "sampling_date", SIGMA_GRID).withColumnRenamed("cov", "v")


def glasso_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """sampling_date, i, j, s, cov, prec: the sample's covariance, the graphical lasso's, and its precision."""

    tasks = E.lasso_tasks(MO.on_complete_days(rolling(spark, sf), "sampling_date").where("dates >= 8"), "sampling_date", 2).where("fold = -1")
    points = tasks.select("sampling_date", F.lit(0.01).alias("alpha"))
    place = lambda k: F.element_at("names", k.cast("int"))
    flat = tasks.select("sampling_date", "names", F.size("names").alias("n"), F.posexplode("s").alias("at", "s"))
    sample = flat.select("sampling_date", place(F.floor(F.col("at") / F.col("n")) + 1).alias("i"), place(F.col("at") % F.col("n") + 1).alias("j"), "s")
    return E.lasso_fits(tasks, points, "sampling_date").join(sample, ["sampling_date", "i", "j"])


@query("sparsity_stats", "sampling_date:d cov_density:f6 prec_density:f6 prec_used:i df_full:i")
def sparsity_stats(spark: SparkSession, sf: str) -> DataFrame:
    # the precision is symmetric: of its entries those on and above the diagonal are free
    used = F.count_if((F.abs("prec") > 1e-8) & (F.col("i") <= F.col("j")))
    return glasso_pairs(spark, sf).groupBy("sampling_date").agg(
        F.avg((F.abs("cov") > 1e-8).cast("double")).alias("cov_density"), F.avg((F.abs("prec") > 1e-8).cast("double")).alias("prec_density"),
        used.alias("prec_used"), F.count_if(F.col("i") <= F.col("j")).alias("df_full"),
    )


#: Points of the sign nets' search: shares of the absolute penalty, and penalties of the stacked problem.
SIGN_POINTS = [(a, u) for a in (0.25, 0.5, 0.75, 1.0) for u in (0.0001, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)]


def sign_net_sql(tail: str) -> str:
    """c (window, i, j, fold, n, s, q), l (losses by window and point) and b (the best point), then ``tail``."""
    soft = lambda m: f"sign({m}) * greatest(abs({m}) - u * k * k * alpha, 0) / (1 + u * k * k * (1 - alpha))"
    points = ", ".join(f"({a}, {u})" for a, u in SIGN_POINTS)
    windows = SAMPLES.replace("m.*", "v.*").replace("FROM m", "FROM v").replace("range(0, 12)", "range(0, 36)")
    return f"""WITH {REGIONS}, {windows}, sn AS (SELECT sampling_date, count(DISTINCT permno) AS k FROM s GROUP BY 1), fd AS (SELECT sampling_date, date, k, row_number() OVER (PARTITION BY sampling_date ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY sampling_date) AS t FROM (SELECT sampling_date, date, k FROM s JOIN sn USING (sampling_date) GROUP BY 1, 2, 3 HAVING count(x) = k)),
  fo AS (SELECT *, CASE WHEN r < (t % 12) * (t // 12 + 1) THEN r // (t // 12 + 1) ELSE t % 12 + (r - (t % 12) * (t // 12 + 1)) // (t // 12) END AS fold FROM fd WHERE t >= 24),
  o AS (SELECT sampling_date, date, permno, k, fold, sign(round(x - avg(x) OVER (PARTITION BY sampling_date, permno), 10)) AS a FROM s JOIN fo USING (sampling_date, date)),
  c AS (SELECT p.sampling_date, p.k, p.permno AS i, q.permno AS j, p.fold, count(*) AS n, sum(p.a * q.a) AS s, sum(abs(p.a * q.a)) AS q FROM o p JOIN o q USING (sampling_date, date) WHERE p.permno <= q.permno GROUP BY 1, 2, 3, 4, 5),
  rs AS (SELECT *, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS m, CASE WHEN i < j THEN 2 ELSE 1 END AS w2 FROM c WINDOW w AS (PARTITION BY sampling_date, i, j)),
  f AS (SELECT sampling_date, alpha, u, fold, sum(w2 * (q - 2 * b * s + n * b * b)) / sum(w2 * n) AS loss FROM (SELECT *, {soft("m")} AS b FROM rs, (SELECT CAST(column0 AS DOUBLE) AS alpha, CAST(column1 AS DOUBLE) AS u FROM (VALUES {points}) g(column0, column1))) GROUP BY 1, 2, 3, 4),
  l AS (SELECT sampling_date, alpha, u, avg(loss) AS loss FROM f GROUP BY 1, 2, 3), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY sampling_date ORDER BY round(loss, 9), u DESC, alpha DESC) = 1)
  {tail.replace("SOFT", soft("m"))}"""


@query("sign_net_cv", "sampling_date:d i:i j:i v:f6 alpha:f2 lambdau:f6", sign_net_sql("SELECT sampling_date, i, j, SOFT AS v, alpha, u AS lambdau FROM (SELECT sampling_date, k, i, j, sum(s) / sum(n) AS m FROM c GROUP BY 1, 2, 3, 4) JOIN b USING (sampling_date)"))
def sign_net_cv(spark: SparkSession, sf: str) -> DataFrame:
    return CN.search(rolling(spark, sf), "sampling_date", SIGN_POINTS)


@query("sign_net_losses", "sampling_date:d alpha:f2 lambdau:f6 loss:f6", sign_net_sql("SELECT sampling_date, alpha, u AS lambdau, loss FROM l"))
def sign_net_losses(spark: SparkSession, sf: str) -> DataFrame:
    return CN.losses(CN.sign_sums(rolling(spark, sf), "sampling_date", 12, 24), "sampling_date", SIGN_POINTS)


@query("adaptive_threshold_cov", "i:i j:i v:f8", f"""WITH {REGIONS}, o AS (SELECT permno, date, x - avg(x) OVER (PARTITION BY permno) AS x FROM v), p AS (SELECT a.permno AS i, b.permno AS j, a.x * b.x AS p FROM o a JOIN o b USING (date)),
  s AS (SELECT i, j, sum(p) / (count(*) - 1) AS cov, count(*) AS t FROM p GROUP BY 1, 2), th AS (SELECT i, j, avg(pow(p - cov, 2)) AS theta, max(cov) AS cov, max(t) AS t FROM p JOIN s USING (i, j) GROUP BY 1, 2), n AS (SELECT count(DISTINCT permno) AS n FROM v)
  SELECT i, j, CASE WHEN abs(cov) > z THEN sign(cov) * (abs(cov) - z) ELSE 0 END AS v FROM (SELECT i, j, cov, CAST('{K.normal_quantile(0.9)!r}' AS DOUBLE) * sqrt(theta * ln(n) / t) AS z FROM th, n)""")
def adaptive_threshold_cov(spark: SparkSession, sf: str) -> DataFrame:
    v = regions(spark, sf).withColumn("all", F.lit(1))
    return E.threshold_covariance(v, "all", 0.9, rule="soft")


@query("correlation_sign_net", "i:i j:i v:f6", f"WITH {REGIONS}, o AS (SELECT permno, date, x - avg(x) OVER (PARTITION BY permno) AS x FROM v) SELECT a.permno AS i, b.permno AS j, avg(sign(a.x * b.x)) AS v FROM o a JOIN o b ON a.date = b.date AND a.permno < b.permno GROUP BY 1, 2")
def correlation_sign_net(spark: SparkSession, sf: str) -> DataFrame:
    o = regions(spark, sf).withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("permno")))
    return P.pairs(o, "x", "permno", "date").where("i < j").groupBy("i", "j").agg(F.avg(F.signum(F.col("x_i") * F.col("x_j"))).alias("v"))


@query("partial_corr", "i:i j:i corr:f6 pcorr:f6", f"""WITH RECURSIVE {REGIONS}, s AS (SELECT a.permno AS i, b.permno AS j, covar_samp(a.x, b.x) AS v FROM v a JOIN v b USING (date) GROUP BY 1, 2),
  aug AS (SELECT i, list(w ORDER BY kind, j) AS r FROM (SELECT i, 0 AS kind, j, v AS w FROM s UNION ALL SELECT i, 1, j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE 0 END FROM s) GROUP BY 1), {GAUSS_JORDAN},
  p AS (SELECT ids[f] AS i, ids[g] AS j, m[f][len(ids) + g] / sqrt(m[f][len(ids) + f] * m[g][len(ids) + g]) AS v FROM sol, range(1, 200) q(f), range(1, 200) w(g) WHERE f <= len(ids) AND g <= len(ids))
  SELECT s.i, s.j, s.v / sqrt(a.v * b.v) AS corr, CASE WHEN s.i = s.j THEN 1 ELSE -p.v END AS pcorr FROM s JOIN s a ON a.i = s.i AND a.j = s.i JOIN s b ON b.i = s.j AND b.j = s.j JOIN p ON p.i = s.i AND p.j = s.j""")
def partial_corr(spark: SparkSession, sf: str) -> DataFrame:
    s = P.covariances(regions(spark, sf), "x").withColumnRenamed("cov", "v")
    return M.scaled_by_diagonal(s).withColumnRenamed("v", "corr").join(partial_corr_precision(spark, sf).select("i", "j", "pcorr"), ["i", "j"])


@query("partial_corr_precision", "i:i j:i pcorr:f6")
def partial_corr_precision(spark: SparkSession, sf: str) -> DataFrame:
    v = regions(spark, sf).withColumn("all", F.lit(1))
    return E.covariance(v, "all", lambda s: K.partial_correlation(np.linalg.pinv(s))).withColumnRenamed("v", "pcorr")


@query("shrinkage", "sampling_date:d shrinkage:f6")
def shrinkage(spark: SparkSession, sf: str) -> DataFrame:
    off = F.col("i") != F.col("j")
    kept = F.avg(F.when(off, F.abs("cov"))) / F.avg(F.when(off, F.abs("s")))
    return glasso_pairs(spark, sf).groupBy("sampling_date").agg((1 - kept).alias("shrinkage"))


# --- decompositions ----------------------------------------------------------------------------

# a small coefficient matrix and covariance that SQL can follow: a tenth of the lagged correlations
AC = f"{VAR}, a AS (SELECT equation AS i, source AS j, coef AS v FROM bb), s AS (SELECT x.permno AS i, y.permno AS j, covar_samp(x.resid, y.resid) AS v FROM r x JOIN r y USING (date) GROUP BY 1, 2), e AS (SELECT DISTINCT i, i AS j, CAST(1 AS DOUBLE) AS v FROM s)"
P2 = "a2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2)"
SUM2 = "u AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM e UNION ALL SELECT * FROM a UNION ALL SELECT * FROM a2) GROUP BY 1, 2), irv AS (SELECT u.i, s.j, sum(u.v * s.v) AS v FROM u JOIN s ON u.j = s.i GROUP BY 1, 2)"


def small_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(coefficients, residual covariance) of the first-order model of all series, as edges."""
    v, coefs = fitted_var(spark, sf)
    a = coefs.where("term = 'lag1'").select(F.col("equation").alias("i"), F.col("source").alias("j"), F.col("coef").alias("v"))
    return a, P.covariances(E.residual_rows(v, coefs, "all").select("permno", "date", F.col("resid").alias("x")), "x").withColumnRenamed("cov", "v")


@query("vma_h", "h:i i:i j:i v:f8", f"WITH RECURSIVE {REGIONS}, {AC}, {P2} SELECT 0 AS h, * FROM (SELECT a.i, a.j, coalesce(e.v, 0) AS v FROM a LEFT JOIN e USING (i, j)) WHERE v <> 0 UNION ALL SELECT 1, * FROM a UNION ALL SELECT 2, * FROM a2")
def vma_h(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = small_model(spark, sf)
    parts = [p.withColumn("h", F.lit(h)) for h, p in enumerate(M.vma(a, 2))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("irv", "i:i j:i v:f8", f"WITH RECURSIVE {REGIONS}, {AC}, {P2}, {SUM2} SELECT i, j, v FROM irv")
def irv(spark: SparkSession, sf: str) -> DataFrame:
    return M.irv(*small_model(spark, sf), 3)


@query("mse_h", "i:i mse:f8", f"""WITH RECURSIVE {REGIONS}, {AC}, {P2}, ph AS (SELECT 0 AS h, * FROM e UNION ALL SELECT 1, * FROM a UNION ALL SELECT 2, * FROM a2), t AS (SELECT h, ph.i, s.j, sum(ph.v * s.v) AS v FROM ph JOIN s ON ph.j = s.i GROUP BY 1, 2, 3)
  SELECT t.i, sum(t.v * ph.v) AS mse FROM t JOIN ph ON ph.h = t.h AND ph.i = t.i AND ph.j = t.j GROUP BY 1""")
def mse_h(spark: SparkSession, sf: str) -> DataFrame:
    return M.mse(*small_model(spark, sf), 2)


@query("irf_diag", "i:i j:i v:f8", f"WITH RECURSIVE {REGIONS}, {AC} SELECT a.i, s.j, sum(a.v * s.v) / sqrt(max(d.v)) AS v FROM a JOIN s ON a.j = s.i JOIN s d ON d.i = s.j AND d.j = s.j GROUP BY 1, 2")
def irf_diag(spark: SparkSession, sf: str) -> DataFrame:
    a, s = small_model(spark, sf)
    d = s.where("i = j").select("j", F.col("v").alias("d"))
    return M.matmul(a, s).join(F.broadcast(d), "j").withColumn("v", F.col("v") / F.sqrt("d"))


@query("index_variance_decomp", "j:i v:f8", f"WITH RECURSIVE {REGIONS}, {AC}, {P2}, {SUM2} SELECT j, sum(v / 5) / 5 AS v FROM irv GROUP BY 1")
def index_variance_decomp(spark: SparkSession, sf: str) -> DataFrame:
    weight = 1 / 5
    return M.irv(*small_model(spark, sf), 3).groupBy("j").agg((F.sum(F.col("v") * weight) * weight).alias("v"))


def estimates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(coefficients, covariances) of the rolling regional models."""
    w = rolling(spark, sf)
    coefs = E.var_ols(w, "sampling_date")

    return coefs, E.var_covariance(w, "sampling_date", least=12)


def product_sql(a: str, b: str) -> str:
    return f"list_transform({a}, lambda r: list_transform(range(1, len({b}) + 1), lambda c: list_dot_product(r, list_transform({b}, lambda q: q[c]))))"


def decomposition_sql(horizon: int) -> str:
    """fev (window, i, j, v) of every window: the residuals' covariance, its root by the coupled Newton iteration,
    and the responses' squares over the horizon; a row's sum is its mean squared error, as the root is symmetric."""
    unit = "list_transform(range(1, len(ids) + 1), lambda o: list_transform(range(1, len(ids) + 1), lambda c: CASE WHEN o = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"
    half = "list_transform({0}, lambda r: list_transform(r, lambda q: q / 2))"
    return f"""{window_fit_sql()}, res AS (SELECT u.sampling_date, u.date, u.permno AS i, any_value(u.y) - sum(coef * o.z) AS e FROM cu u JOIN wb ON wb.sampling_date = u.sampling_date AND equation = u.permno
    JOIN cu o ON o.sampling_date = u.sampling_date AND o.date = u.date AND o.permno = source GROUP BY 1, 2, 3),
  cv AS (SELECT a.sampling_date, a.i, b.i AS j, covar_samp(a.e, b.e) AS v FROM res a JOIN res b USING (sampling_date, date) GROUP BY 1, 2, 3 HAVING count(*) >= 11),
  sm AS (SELECT sampling_date, list(r ORDER BY i) AS sg, list(i ORDER BY i) AS ids, sqrt(sum(ss)) AS size FROM (SELECT sampling_date, i, list(v ORDER BY j) AS r, sum(v * v) AS ss FROM cv GROUP BY 1, 2) GROUP BY 1),
  am AS (SELECT sampling_date, list(r ORDER BY equation) AS am FROM (SELECT sampling_date, equation, list(coef ORDER BY source) AS r FROM wb GROUP BY 1, 2) GROUP BY 1),
  nw AS (SELECT sampling_date, 0 AS k, ids, list_transform(sg, lambda r: list_transform(r, lambda q: q / size)) AS yy, {unit} AS zz FROM sm
    UNION ALL SELECT sampling_date, k + 1, ids, {half.format(product_sql('yy', 'tt'))}, {half.format(product_sql('tt', 'zz'))} FROM (SELECT sampling_date, k, ids, yy, zz,
      list_transform(zy, lambda r, o: list_transform(r, lambda q, c: CASE WHEN o = c THEN 3 - q ELSE -q END)) AS tt FROM (SELECT *, {product_sql('zz', 'yy')} AS zy FROM nw WHERE k < 40))),
  rt AS (SELECT sampling_date, nw.ids, am, list_transform(yy, lambda r: list_transform(r, lambda q: q * sqrt(size))) AS rt FROM nw JOIN sm USING (sampling_date) JOIN am USING (sampling_date) WHERE k = 40),
  rs AS (SELECT sampling_date, 0 AS h, ids, am, rt AS im FROM rt UNION ALL SELECT sampling_date, h + 1, ids, am, {product_sql('am', 'im')} FROM rs WHERE h < {horizon}),
  fev AS (SELECT sampling_date, ids[f] AS i, ids[g] AS j, sum(pow(im[f][g], 2)) AS v FROM rs, range(1, 200) q(f), range(1, 200) w(g) WHERE f <= len(ids) AND g <= len(ids) GROUP BY 1, 2, 3)"""


def inverse_sql(table: str) -> str:
    """inv (window, i, j, v): the inverses of a table of cells, by elimination."""
    jordan = WINDOW_JORDAN
    for name in ("aug", "m0", "gj", "sol"):
        jordan = jordan.replace(f"{name} AS", f"{name}_inv AS").replace(f"FROM {name} ", f"FROM {name}_inv ")
    return f"""aug_inv AS (SELECT sampling_date, i, list(w ORDER BY kind, j) AS r FROM (SELECT sampling_date, i, 0 AS kind, j, v AS w FROM {table}
    UNION ALL SELECT sampling_date, i, 1, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {table}) GROUP BY 1, 2),
  {jordan}, inv AS (SELECT sampling_date, ids[f] AS i, ids[g] AS j, m[f][len(ids) + g] AS v FROM sol_inv, range(1, 200) q(f), range(1, 200) w(g) WHERE f <= len(ids) AND g <= len(ids))"""


FEV = decomposition_sql(21)
SHARES = {"fev": "v", "fu": "sqrt(v)", "fevd": "v / sum(v) OVER (PARTITION BY sampling_date, i)", "fud": "sqrt(v) / sum(sqrt(v)) OVER (PARTITION BY sampling_date, i)"}
FEVD = f"{FEV}, tb AS (SELECT sampling_date, i, j, {SHARES['fevd']} AS v FROM fev)"


def table_query(name: str, table: str, horizon: int) -> None:
    @query(name, "sampling_date:d i:i j:i v:f4", f"WITH RECURSIVE {REGIONS}, {decomposition_sql(horizon)} SELECT sampling_date, i, j, {SHARES[table]} AS v FROM fev")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        coefs, covs = estimates(spark, sf)
        key = covs.select("sampling_date").distinct()
        return E.decompositions(coefs.join(key, "sampling_date", "left_semi"), covs, "sampling_date", table, horizon)


table_query("fevd", "fevd", 21)
table_query("fev", "fev", 21)
table_query("fud", "fud", 21)
table_query("fu", "fu", 21)


def fevd_table(spark: SparkSession, sf: str) -> DataFrame:
    coefs, covs = estimates(spark, sf)
    key = covs.select("sampling_date").distinct()
    return E.decompositions(coefs.join(key, "sampling_date", "left_semi"), covs, "sampling_date", "fevd", 21)


@query("fevd_edges", "sampling_date:d src:i dst:i weight:f4", f"WITH RECURSIVE {REGIONS}, {FEVD} SELECT sampling_date, j AS src, i AS dst, v AS weight FROM tb WHERE i <> j")
def fevd_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fevd_table(spark, sf).where("i <> j").select("sampling_date", F.col("j").alias("src"), F.col("i").alias("dst"), F.col("v").alias("weight"))


@query("fevd_stats", "sampling_date:d node:i n_in:f4 n_out:f4 n_net:f4", f"""WITH RECURSIVE {REGIONS}, {FEVD} SELECT sampling_date, node, n_in, n_out, n_out - n_in AS n_net FROM (SELECT sampling_date, i AS node, sum(v) AS n_in FROM tb WHERE i <> j GROUP BY 1, 2)
  JOIN (SELECT sampling_date, j AS node, sum(v) AS n_out FROM tb WHERE i <> j GROUP BY 1, 2) USING (sampling_date, node)""")
def fevd_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.connectedness(fevd_table(spark, sf), ["sampling_date"])


@query("generalized_cov", "sampling_date:d i:i j:i v:f4", f"""WITH RECURSIVE {REGIONS}, {FEV}, {inverse_sql('cv')} SELECT inv.sampling_date, inv.i, inv.j, sqrt(a.v) * inv.v * sqrt(b.v) AS v
  FROM inv JOIN cv a ON a.sampling_date = inv.sampling_date AND a.i = inv.i AND a.j = inv.i JOIN cv b ON b.sampling_date = inv.sampling_date AND b.i = inv.j AND b.j = inv.j""")
def generalized_cov(spark: SparkSession, sf: str) -> DataFrame:
    _, covs = estimates(spark, sf)
    return M.by_window(covs, "sampling_date", lambda n, m: M.edge_rows(n, K.Decomposition([], m).generalised_cov()), "i long, j long, v double")


@query("diag_test", "sampling_date:d stat:f4 p:f6")
def diag_test(spark: SparkSession, sf: str) -> DataFrame:
    _, covs = estimates(spark, sf)

    def test(n: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        stat, p = K.Decomposition([], m).diagonality(36)
        return pd.DataFrame({"stat": [stat], "p": [p]})

    return M.by_window(covs, "sampling_date", test, "stat double, p double")


@query("estimate_fevd", "sampling_date:d i:i j:i v:f3")
def estimate_fevd(spark: SparkSession, sf: str) -> DataFrame:
    return E.estimate_fevd(rolling(spark, sf), R.grid(spark, VAR_GRID), "sampling_date", COV_GRID, ("mkt",))


@query("describe_var_cov", "sampling_date:d statistic:s value:f4")
def describe_var_cov(spark: SparkSession, sf: str) -> DataFrame:
    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        x = E.wide(pdf)
        d, y = K.lagged(x.to_numpy(), 1)
        b = K.ols(d, y)
        e = y - d @ b
        s = np.cov(e, rowvar=False)
        a = b[1:].T
        stats = {
            "t": len(y), "n": y.shape[1], "r2": 1 - (e**2).sum() / ((y - y.mean(axis=0)) ** 2).sum(), "asymmetry": K.asymmetry(a), "asymmetry_off": K.asymmetry(a, True),
            "spectral_radius": np.abs(np.linalg.eigvals(a)).max(), "mean_abs": np.abs(a).mean(), "logdet": np.linalg.slogdet(s)[1],
            "log_likelihood": -len(y) / 2 * (y.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + y.shape[1]), "mean_correlation": K.to_correlation(s)[np.triu_indices(len(s), 1)].mean(),
        }
        return pd.DataFrame({"statistic": list(stats), "value": [float(v) for v in stats.values()]})

    return E.windows(rolling(spark, sf), "sampling_date", describe, "statistic string, value double", least=12)


@query("describe_search", "sampling_date:d statistic:s value:f3")
def describe_search(spark: SparkSession, sf: str) -> DataFrame:
    return DE.describe_search(rolling(spark, sf), R.grid(spark, VAR_GRID), "sampling_date", COV_GRID, ("mkt",))


@query("collect_var_cov", "permno:i mean_in:f6 mean_out:f6 var:f8", f"WITH RECURSIVE {REGIONS}, {AC} SELECT x.i AS permno, mean_in, mean_out, s.v AS var FROM (SELECT i, avg(CASE WHEN i <> j THEN abs(v) END) AS mean_in FROM a GROUP BY 1) x JOIN (SELECT j, avg(CASE WHEN i <> j THEN abs(v) END) AS mean_out FROM a GROUP BY 1) y ON x.i = y.j JOIN s ON s.i = x.i AND s.j = x.i")
def collect_var_cov(spark: SparkSession, sf: str) -> DataFrame:
    a, s = small_model(spark, sf)
    off = F.avg(F.when(F.col("i") != F.col("j"), F.abs("v")))
    got, sent = a.groupBy(F.col("i").alias("permno")).agg(off.alias("mean_in")), a.groupBy(F.col("j").alias("permno")).agg(off.alias("mean_out"))
    return got.join(sent, "permno").join(s.where("i = j").select(F.col("i").alias("permno"), F.col("v").alias("var")), "permno")


@query("df_stats", "sampling_date:d n:i df_full:i df_used:i share:f6")
def df_stats(spark: SparkSession, sf: str) -> DataFrame:
    lags, used = elastic_net(spark, sf).where("term like 'lag%'").groupBy("sampling_date"), F.count_if(F.col("coef") != 0)
    return lags.agg(F.count_distinct("equation").alias("n"), F.count(F.lit(1)).alias("df_full"), used.alias("df_used"), (used / F.count(F.lit(1))).alias("share"))


# --- networks ----------------------------------------------------------------------------------

NET = "n AS (SELECT c_nationkey AS i, s_nationkey AS j, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """i, j, v: what customers of nation i bought from suppliers of nation j."""
    l, o, c, s = (T.table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = (
        l.select("l_orderkey", "l_suppkey", "l_extendedprice").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum("l_extendedprice").alias("v"))


CONN = "k AS (SELECT x.i AS node, n_in, n_out, n_self, n_in + n_out AS n_total, n_out - n_in AS n_net FROM (SELECT i, coalesce(sum(CASE WHEN i <> j THEN v END), 0) AS n_in, sum(CASE WHEN i = j THEN v END) AS n_self FROM n GROUP BY 1) x JOIN (SELECT j, coalesce(sum(CASE WHEN i <> j THEN v END), 0) AS n_out FROM n GROUP BY 1) y ON x.i = y.j)"


@query("connectedness", "node:i n_in:f1 n_out:f1 n_self:f1 n_total:f1 n_net:f1", f"WITH {NET}, {CONN} SELECT * FROM k")
def connectedness(spark: SparkSession, sf: str) -> DataFrame:
    return M.connectedness(flows(spark, sf))


@query("amplification_absorption", "node:i amplification:f6 absorption:f6", f"WITH {NET}, {CONN} SELECT node, n_out / nullif(n_in, 0) AS amplification, n_self / nullif(n_in, 0) AS absorption FROM k")
def amplification_absorption(spark: SparkSession, sf: str) -> DataFrame:
    k = connectedness(spark, sf)
    return k.withColumn("amplification", C.ratio(F.col("n_out"), F.col("n_in"))).withColumn("absorption", C.ratio(F.col("n_self"), F.col("n_in")))


@query("avg_connectedness", "average:f1", f"WITH {NET}, {CONN} SELECT avg(n_in) AS average FROM k")
def avg_connectedness(spark: SparkSession, sf: str) -> DataFrame:
    return connectedness(spark, sf).agg(F.avg("n_in").alias("average"))


def _concentration(side: str) -> None:
    a = "i" if side == "in" else "j"
    sql = f"""WITH {NET}, p AS (SELECT {a} AS node, v / sum(v) OVER (PARTITION BY {a}) AS p FROM n WHERE i <> j), q AS (SELECT *, ln(p / min(p) OVER (PARTITION BY node)) AS l FROM p)
      SELECT node, sum(p * p) AS hhi, -sum(p * ln(p)) / nullif(ln(count(*)), 0) AS entropy, 1 / (1 + count(*) / nullif(sum(l), 0)) AS power FROM q GROUP BY 1"""

    @query(f"{side}_concentration", "node:i hhi:f6 entropy:f6 power:f6", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        n = flows(spark, sf)
        one = lambda m, name: M.concentration(n, side=side, measure=m).withColumnRenamed("value", name)
        return one("herfindahl_index", "hhi").join(one("entropy", "entropy"), "node").join(one("power_law_exponent", "power"), "node")


_concentration("in")
_concentration("out")


@query("asymmetry", "asymmetry:f6", f"WITH {NET} SELECT sum(abs((coalesce(a.v, 0) - coalesce(b.v, 0)) / 2)) / sum(abs(coalesce(a.v, 0))) AS asymmetry FROM n a FULL JOIN n b ON a.i = b.j AND a.j = b.i")
def asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    return M.asymmetry(flows(spark, sf))


def one_window(spark: SparkSession, sf: str) -> DataFrame:
    n = flows(spark, sf)
    total = F.sum("v").over(Window.partitionBy("i"))
    return n.withColumn("v", F.col("v") / total).withColumn("w", F.lit(1))


def power_sql(incoming: str, outgoing: str) -> str:
    """Dominant vectors of two matrices, given by their cells (i, j) over the dense table, by sixty steps of the power method."""
    return f"""ids AS (SELECT i AS id FROM n UNION SELECT j FROM n), dense AS (SELECT a.id AS i, b.id AS j, coalesce(v, 0) AS v FROM ids a CROSS JOIN ids b LEFT JOIN n ON n.i = a.id AND n.j = b.id),
  rowed AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM dense), scaled AS (SELECT i, j, v, v / sum(v) OVER (PARTITION BY j) AS vc, 1.0 / sqrt(count(*) OVER ()) AS one FROM rowed),
  cells AS (SELECT 'in' AS side, i AS a, j AS b, {incoming} AS g FROM scaled UNION ALL SELECT 'out', j, i, {outgoing} FROM scaled),
  p0 AS (SELECT side, list(r ORDER BY a) AS m, list(a ORDER BY a) AS nodes FROM (SELECT side, a, list(CAST(g AS DOUBLE) ORDER BY b) AS r FROM cells GROUP BY 1, 2) GROUP BY 1),
  it AS (SELECT side, 0 AS k, m, nodes, list_transform(nodes, lambda o: CAST(1 AS DOUBLE)) AS x FROM p0 UNION ALL
    SELECT side, k + 1, m, nodes, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) FROM (SELECT side, k, m, nodes, list_transform(m, lambda r: list_dot_product(r, x)) AS y FROM it WHERE k < 60))
  SELECT node, max(CASE WHEN side = 'in' THEN v END) AS n_in, max(CASE WHEN side = 'out' THEN v END) AS n_out FROM (SELECT side, unnest(nodes) AS node, unnest(x) AS v FROM it WHERE k = 60) GROUP BY 1"""


@query("eigenvector_centrality", "node:i n_in:f5 n_out:f5", f"WITH RECURSIVE {NET}, {power_sql('v', 'v')}")
def eigenvector_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return M.eigenvector_centrality(one_window(spark, sf), "w")


@query("pagerank", "node:i n_in:f5 n_out:f5", f"WITH RECURSIVE {NET}, {power_sql('0.85 * vc + 0.15 * one', '0.85 * v + 0.15 * one')}")
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return M.page_rank(one_window(spark, sf), "w")


@query("leontief_network", "sampling_date:d node:i n_in:f4 n_out:f4", f"""WITH RECURSIVE {REGIONS}, {FEVD}, less AS (SELECT sampling_date, i, j, CASE WHEN i = j THEN 1 ELSE -v END AS v FROM tb), {inverse_sql('less')}
  SELECT sampling_date, node, n_in, n_out FROM (SELECT sampling_date, i AS node, sum(v) AS n_in FROM inv WHERE i <> j GROUP BY 1, 2) JOIN (SELECT sampling_date, j AS node, sum(v) AS n_out FROM inv WHERE i <> j GROUP BY 1, 2) USING (sampling_date, node)""")
def leontief_network(spark: SparkSession, sf: str) -> DataFrame:
    return M.connectedness(M.leontief(fevd_table(spark, sf), "sampling_date"), ["sampling_date"])


@query("weighted_table", "i:i j:i v:f8", f"WITH {NET} SELECT n.i, n.j, n.v / t.v * n.v / r.v AS v FROM n JOIN (SELECT i, sum(v) AS v FROM n GROUP BY 1) r USING (i), (SELECT sum(v) AS v FROM n) t")
def weighted_table(spark: SparkSession, sf: str) -> DataFrame:
    n = flows(spark, sf)
    total = n.agg(F.sum("v").alias("t"))
    row = F.sum("v").over(Window.partitionBy("i"))
    return n.withColumn("r", row).join(F.broadcast(total)).withColumn("v", F.col("v") / F.col("t") * F.col("v") / F.col("r"))


@query("network_stats", "nodes:i total:f0 avg_in:f1 hhi_in:f6 hhi_out:f6 asymmetry:f6", f"""WITH {NET}, {CONN}, p AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS pi, v / sum(v) OVER (PARTITION BY j) AS pj FROM n WHERE i <> j)
  SELECT (SELECT count(*) FROM k) AS nodes, (SELECT sum(v) FROM n) AS total, (SELECT avg(n_in) FROM k) AS avg_in, (SELECT avg(h) FROM (SELECT sum(pi * pi) AS h FROM p GROUP BY i)) AS hhi_in, (SELECT avg(h) FROM (SELECT sum(pj * pj) AS h FROM p GROUP BY j)) AS hhi_out,
  (SELECT sum(abs((coalesce(a.v, 0) - coalesce(b.v, 0)) / 2)) / sum(abs(coalesce(a.v, 0))) FROM n a FULL JOIN n b ON a.i = b.j AND a.j = b.i) AS asymmetry""")
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = flows(spark, sf)
    parts = [
        M.connectedness(n).agg(F.count(F.lit(1)).alias("nodes"), F.avg("n_in").alias("avg_in")), n.agg(F.sum("v").alias("total")),
        M.concentration(n, side="in").agg(F.avg("value").alias("hhi_in")), M.concentration(n, side="out").agg(F.avg("value").alias("hhi_out")), M.asymmetry(n),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


# --- return spillovers ---------------------------------------------------------------------------


def region_flows(spark: SparkSession, sf: str) -> DataFrame:
    """i, j, v: row-normalised flows between regions, the proxy network."""
    nation = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    n = flows(spark, sf)
    g = n.join(F.broadcast(nation), n.i == nation.k).drop("k", "i").withColumnRenamed("r", "i").join(F.broadcast(nation), F.col("j") == F.col("k")).drop("k", "j").withColumnRenamed("r", "j")
    r = g.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return r.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("i")))


RFLOW = f"{NET}, rf0 AS (SELECT a.n_regionkey AS i, b.n_regionkey AS j, sum(v) AS v FROM n JOIN nation a ON a.n_nationkey = n.i JOIN nation b ON b.n_nationkey = n.j GROUP BY 1, 2), rfl AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM rf0)"


def growth(spark: SparkSession, sf: str) -> DataFrame:
    v = regions(spark, sf)
    d = v.withColumn("x", F.col("x") - F.lag("x").over(Window.partitionBy("permno").orderBy("date"))).where("x is not null")
    m = d.groupBy("date").agg(F.avg("x").alias("mkt"))
    return d.join(m, "date").withColumn("all", F.lit(1))


@query("spill_lag", "permno:i date:d wr:f6", f"WITH {REGIONS}, {RFLOW}, g AS (SELECT permno, date, x - lag(x) {BY}) AS x FROM v) SELECT i AS permno, date, sum(rfl.v * g.x) AS wr FROM rfl JOIN g ON g.permno = rfl.j WHERE i <> j AND x IS NOT NULL GROUP BY 1, 2")
def spill_lag(spark: SparkSession, sf: str) -> DataFrame:
    w = region_flows(spark, sf).where("i <> j")
    joined = growth(spark, sf).withColumnRenamed("permno", "j").join(F.broadcast(w), "j")
    return joined.groupBy(F.col("i").alias("permno"), "date").agg(F.sum(F.col("v") * F.col("x")).alias("wr"))


def spill_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = growth(spark, sf)
    # the market of the windows is the first region's own shock, so that it is no exact sum of the others
    df = df.withColumn("mkt", F.max(F.when(F.col("permno") == 0, F.col("x"))).over(Window.partitionBy("date"))).where("permno > 0")
    return df, region_flows(spark, sf).where("i > 0 and j > 0")


def _spill(name: str, columns: str, method: str, schema: str, out, rolling_windows: bool = False) -> None:  # noqa: ANN001
    @query(name, columns)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, net = spill_panel(spark, sf)
        if rolling_windows:
            df = P.rolling_samples(df, 36)
        return SP.fitted(df, net, "sampling_date" if rolling_windows else "all", lambda model: out(getattr(model(), f"fit_{method}")()), schema)


def _parameters(m: SP.Model) -> pd.DataFrame:
    return pd.DataFrame({"permno": m.net.labels, "c": m.c, "alpha": m.alpha, "beta": m.beta[:, 0]})


for _method in ("ols", "wls", "mle"):
    _spill(f"spill_{_method}", "permno:i c:f5 alpha:f5 beta:f5", _method, "permno long, c double, alpha double, beta double", _parameters)
_spill("structural_matrix", "i:i j:i v:f5", "mle", "i long, j long, v double", lambda m: M.edge_rows(m.net.labels, m.inverse))
_spill("wald_lr_aic", "wald:f3 wald_p:f6 lr:f3 lr_p:f6 aic:f3", "mle", "wald double, wald_p double, lr double, lr_p double, aic double", lambda m: pd.DataFrame([[*m.wald(), *m.likelihood_ratio(), m.aic()]], columns=["wald", "wald_p", "lr", "lr_p", "aic"]))
_spill("spill_r2", "part:s r2:f5", "mle", "part string, r2 double", lambda m: pd.DataFrame(list(m.partial_r2().items()), columns=["part", "r2"]))
_spill("granular_premia", "permno:i granular_premium:f6 expected_granular:f6 expected_self:f6 expected_others:f6", "mle", "permno long, granular_premium double, expected_granular double, expected_self double, expected_others double",
       lambda m: pd.DataFrame({"permno": m.net.labels} | {k: v for k, v in m.premia(np.full(m.n, 1 / m.n)).items() if k in ("granular_premium", "expected_granular", "expected_self", "expected_others")}))
_spill("variance_decomp_network", "permno:i common:f6 spillover:f6 idiosyncratic:f6", "mle", "permno long, common double, spillover double, idiosyncratic double", lambda m: pd.DataFrame({"permno": m.net.labels} | {k: np.diag(v) for k, v in m.variance_parts().items()}))
_spill("rolling_spill", "sampling_date:d c:f4 log_likelihood:f2", "mle", "c double, log_likelihood double", lambda m: pd.DataFrame({"c": [m.c], "log_likelihood": [m.log_likelihood(m.c)]}), rolling_windows=True)


def _errors(m: SP.Model, errors: tuple[float, np.ndarray, np.ndarray]) -> pd.DataFrame:
    return _parameters(m).assign(se_c=errors[0], se_alpha=errors[1], se_beta=errors[2][:, 0])


for _name, _fit in (("spill_ols_errors", lambda m: _errors(m.fit_ols(), m.pooled_errors())), ("spill_mle_errors", lambda m: _errors(m.fit_mle(), m.standard_errors()))):
    def _with_errors(spark: SparkSession, sf: str, fit=_fit) -> DataFrame:  # noqa: ANN001
        return SP.fitted(*spill_panel(spark, sf), "all", lambda model: fit(model()), "permno long, c double, alpha double, beta double, se_c double, se_alpha double, se_beta double")

    query(_name, "permno:i c:f5 alpha:f5 beta:f5 se_c:f5 se_alpha:f5 se_beta:f5")(_with_errors)

#: What a restricted fit leaves out of the model, and how it is searched.
RESTRICTED = {
    "none": ({}, {}), "no_intercepts": ({"intercepts": False}, {}), "no_factors": ({"loadings": False}, {}),
    "no_spillovers": ({}, {"spillovers": False}), "unconstrained": ({}, {"unconstrained": True}),
}


@query("spill_restricted", "sampling_date:d restriction:s c:f4 log_likelihood:f2 aic:f2")
def spill_restricted(spark: SparkSession, sf: str) -> DataFrame:
    def fit(model) -> pd.DataFrame:  # noqa: ANN001
        fits = [(name, model(**free).fit_mle(**how)) for name, (free, how) in RESTRICTED.items()]
        return pd.DataFrame([(name, m.c, m.log_likelihood(m.c, any_sign=True), 2 * (m.n_params - m.log_likelihood(m.c, any_sign=True))) for name, m in fits], columns=["restriction", "c", "log_likelihood", "aic"])

    df, net = spill_panel(spark, sf)
    return SP.fitted(P.rolling_samples(df, 36), net, "sampling_date", fit, "restriction string, c double, log_likelihood double, aic double")


# --- instruments -----------------------------------------------------------------------------------


# two instruments in closed form: x is the centred fit of mkt on them
@query("iv_2sls", "permno:i term:s coef:f4 se:f4", f"""WITH {MONTHLY}, {MARKET}, {J}, l AS (SELECT permno, ret, mkt, disp, lag(mkt) {BY}) AS lm FROM j), c AS (SELECT * FROM l WHERE ret IS NOT NULL AND mkt IS NOT NULL AND lm IS NOT NULL AND disp IS NOT NULL),
  g AS (SELECT permno, count(*) AS n, avg(mkt) AS m, avg(lm) AS ml, avg(disp) AS md, covar_pop(lm, lm) AS ll, covar_pop(disp, disp) AS dd, covar_pop(lm, disp) AS ld, covar_pop(mkt, lm) AS cl, covar_pop(mkt, disp) AS cd FROM c GROUP BY 1 HAVING count(*) > 4),
  h AS (SELECT permno, n, m, ret, mkt, ((cl * dd - cd * ld) * (lm - ml) + (cd * ll - cl * ld) * (disp - md)) / (ll * dd - ld * ld) AS x FROM c JOIN g USING (permno)),
  b AS (SELECT permno, n, m, avg(ret) AS y, sum(x * x) AS xx, sum(x * ret) / sum(x * x) AS beta FROM h GROUP BY 1, 2, 3),
  e AS (SELECT permno, b.n, b.m, y, beta, xx, sum(pow(ret - y - beta * (mkt - b.m), 2)) / any_value(b.n - 2) AS s2 FROM h JOIN b USING (permno) GROUP BY 1, 2, 3, 4, 5, 6)
  SELECT permno, 'const' AS term, y - beta * m AS coef, sqrt(s2 * (1.0 / n + m * m / xx)) AS se FROM e UNION ALL SELECT permno, 'mkt', beta, sqrt(s2 / xx) FROM e""")
def iv_2sls(spark: SparkSession, sf: str) -> DataFrame:
    j = with_market(spark, sf).withColumn("lm", F.lag("mkt").over(Window.partitionBy("permno").orderBy("date")))
    return IV.regress(j, "ret", ["mkt"], ["lm", "disp"], "permno", "2sls", ["date"])


@query("kclass_iv", "permno:i term:s coef:f4 se:f4 k:f6")
def kclass_iv(spark: SparkSession, sf: str) -> DataFrame:
    j = with_market(spark, sf).withColumn("lm", F.lag("mkt").over(Window.partitionBy("permno").orderBy("date")))
    return IV.regress(j, "ret", ["mkt"], ["lm", "disp", "size"], "permno", "fuller", ["date"])


def many_instruments(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Monthly returns of the companies' securities with 36 instruments: the market's last mean, dispersion
    and size, and the month of the year alone and times the first two."""
    w = Window.orderBy("date")  # one row a date
    f = T.market(spark, sf).select("date", "mkt", *[F.lag(c).over(w).alias(f"l_{c}") for c in ("mkt", "disp", "size")])
    months = [(f"m{k}", (F.month("date") == k).cast("double")) for k in range(2, 13)]
    f = f.withColumns(dict(months)).withColumns({f"{m}_{c}": F.col(m) * F.col(f"l_{c}") for m, _ in months for c in ("mkt", "disp")})
    rows = T.monthly(spark, sf).join(T.securities(spark, sf).select("permno", "permco"), "permno").select("permco", "permno", "date", "ret")
    return rows.join(F.broadcast(f), "date"), [c for c in f.columns if c not in ("date", "mkt")]


@query("hful_iv", "permco:i term:s coef:f4 se:f4 k:f6")
def hful_iv(spark: SparkSession, sf: str) -> DataFrame:
    rows, z = many_instruments(spark, sf)
    return IV.regress(rows, "ret", ["mkt"], z, "permco", "hful", ["permno", "date"])


@query("many_instrument_iv", "permco:i term:s coef:f4 se:f4 k:f6")
def many_instrument_iv(spark: SparkSession, sf: str) -> DataFrame:
    rows, z = many_instruments(spark, sf)
    return IV.regress(rows, "ret", ["mkt"], z, "permco", "fuller", ["permno", "date"], errors="many")


@query("stored_betas", "sampling_date:d permno:i beta:f5 fitted:b", f"""WITH {MONTHLY}, {MARKET}, {J}, {SAMPLES.replace("FROM m,", "FROM j m,")}, t AS (SELECT DISTINCT sampling_date FROM s WHERE date = DATE '1998-06-30')
  SELECT sampling_date, permno, regr_slope(ret, mkt) AS beta, sampling_date IN (SELECT sampling_date FROM t) AS fitted FROM s GROUP BY 1, 2""")
def stored_betas(spark: SparkSession, sf: str) -> DataFrame:
    """Betas of all samples, stored from a panel with preliminary returns of one month, then refreshed with
    the final ones: only samples that hold the month are fitted again."""
    panel = D.scratch(spark, "panel")  # read by both refreshes, for their digests and their fits
    with_market(spark, sf).select("permno", "date", "ret", "mkt").write.parquet(panel)
    final = spark.read.parquet(panel)
    early = final.withColumn("ret", F.when(F.col("date") == F.to_date(F.lit("1998-06-30")), F.round("ret", 2) + 0.005).otherwise(F.col("ret")))
    path = D.scratch(spark, "betas")
    fit = lambda rows: R.one_factor(rows, "ret", "mkt", ["sampling_date", "permno"]).select("sampling_date", "permno", "beta")
    S.refresh(P.rolling_samples(early, 12), "sampling_date", path, fit, "one factor, 12 months")
    held, fitted = S.refresh(P.rolling_samples(final, 12), "sampling_date", path, fit, "one factor, 12 months")
    return held.join(F.broadcast(fitted.withColumn("fitted", F.lit(True))), "sampling_date", "left").withColumn("fitted", F.coalesce("fitted", F.lit(False)))
