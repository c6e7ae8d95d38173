import shutil

import pytest
from pyspark.sql import functions as F

from netpanel.sources import catalog as K
from netpanel.streaming import buckets

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_store_is_a_versioned_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/estimates"
    first = K.store(spark.createDataFrame([(1, 1.0), (2, None)], "k int, a double"), path, ["k"])
    assert first.count() == 1
    second = K.store(spark.createDataFrame([(1, 5.0), (3, 6.0)], "k int, b double"), path, ["k"])
    assert {tuple(r) for r in second.select("k", "a", "b").collect()} == {(1, 1.0, 5.0), (3, None, 6.0)}
    third = K.store(spark.createDataFrame([(3, 7.0)], "k int, b double"), path, ["k"])
    assert {tuple(r) for r in third.select("k", "a", "b").collect()} == {(1, 1.0, None), (3, None, 7.0)}
    assert K.latest(spark, path)[0] == 3


def test_partitioned_write_prunes(spark, tmp_path):
    path = f"file://{tmp_path}/samples"
    df = spark.range(30).select((F.col("id") % 3).alias("year"), F.col("id").alias("x"))
    K.write(df, path, ["year"])
    K.write(df.where("year = 1").withColumn("x", -F.col("x")), path, ["year"])  # only its own folder is replaced
    got = spark.read.parquet(path)
    assert got.where("year = 1 and x > 0").count() == 0 and got.count() == 30
    assert "PartitionFilters: [isnotnull(year" in got.where("year = 2")._jdf.queryExecution().toString()


def test_read_and_search(spark, tmp_path):
    (tmp_path / "q_factors.csv").write_text("DATE,R_MKT\n20200131,NaN\n20200229,1.5\n")
    df = K.dated(K.read(spark, f"file://{tmp_path}/q_factors.csv", "DATE string, R_MKT double"), "DATE")
    assert [(str(r.DATE), r.R_MKT) for r in K.percent_factors(df, "DATE").collect()] == [("2020-01-31", None), ("2020-02-29", 0.015)]
    with pytest.raises(FileNotFoundError, match="q_factors"):
        K.read(spark, f"file://{tmp_path}/factors.csv", "a int")
    for bad in ("x.pkl", "x.csv"):
        with pytest.raises(ValueError):
            K.read(spark, f"file://{tmp_path}/{bad}")
    assert K.search(["a.csv", "a.json", "ab.csv"], "a.csv") == ["a.csv"] and K.search(["a.csv", "a.json", "ab.csv"], "a") == ["a.csv", "a.json"] and K.search(["cab.csv"], "AB") == ["cab.csv"]


def test_query_and_combined(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double")
    assert K.combined([a, b.withColumn("y", F.lit(None).cast("double"))], ["k"]).count() == 2
    assert K.query(spark, "SELECT sum(x) AS s FROM {t}", t=b).first().s == 5.0
    b.createOrReplaceTempView("stocks")
    assert [c for c, _ in K.columns(spark, "stocks")] == ["k", "x"]


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_stream_equals_batch(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    shutil.copy(EVENTS, tmp_path / "in" / "events.parquet")
    fn = getattr(buckets, kind)
    batch = spark.read.parquet(EVENTS)
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    q = fn(stream).writeStream.outputMode("append" if kind == "sessions" else "update").format("memory").queryName(f"out_{kind}").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        got = spark.table(f"out_{kind}").groupBy("start", "end").agg(F.sum("n").alias("n"))
        want = fn(batch).groupBy("start", "end").agg(F.sum("n").alias("n"))
        if kind == "sessions":  # those that end after the watermark are not out yet
            assert got.count() > 0 and got.join(want, ["start", "end", "n"], "left_anti").count() == 0
        else:
            assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        q.stop()
