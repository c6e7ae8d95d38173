"""What queries hold or read again as tables grow: on small tables, by their plans and their parts."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from netpanel.operators import instruments as IV
from netpanel.plans import catalogue
from netpanel.plans import models as M
from netpanel.sources import estimates as S
from test_queries import key

SF = "/root/testdata/sf0.001"


def test_a_trade_meets_one_row_of_the_intervals(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    # some intervals have no code, so that the second brand's is taken beside the first's others
    part.withColumn("p_type", F.when((F.col("p_size") % 5 != 2) & (F.substring("p_brand", 7, 1) != "3"), F.col("p_type"))).write.parquet(f"{tmp_path}/part.parquet")
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    q = catalogue()["interval_join_coalesce"]
    df = q.run(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(con.execute(q.sql).fetchall(), key=key)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(">=" in line or "<=" in line for line in joins)  # a range would give a trade several rows


def test_products_are_summed_where_the_rows_are(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), i, *map(float, rng.normal(size=3))) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, i long, y double, x double, z double")
    la = IV.Layout(["x"], ["z"])
    direct = {r.g: np.array(r.v) for r in IV.summed(IV.blocks(df, "y", la, "g", ["i"], IV.products), "g").collect()}
    packed = {r.g: np.array(r.v) for r in IV.added(IV.blocks(df, "y", la, "g", ["i"]), "g", IV.products, la.width).collect()}
    assert direct.keys() == packed.keys() and all(np.allclose(direct[g], packed[g]) for g in direct)
    plan = IV.regress(df, "y", ["x"], ["z"], "g", "fuller", ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # no second Python worker that holds batches of blocks


def test_the_tables_are_read_once_for_stored_betas_and_windows(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(S, "refresh", lambda inputs, *a, real=S.refresh: rows.append(inputs) or real(inputs, *a))
    assert catalogue()["stored_betas"].run(spark, SF).count() > 0
    assert len(rows) == 2 and not any("l_suppkey" in df._jdf.queryExecution().optimizedPlan().toString() for df in rows)
    windows = M.rolling(spark, SF)._jdf.queryExecution()
    assert "l_suppkey" not in windows.withCachedData().toString().split("InMemoryRelation")[0] and windows.withCachedData().toString().count("InMemoryRelation") >= 2
