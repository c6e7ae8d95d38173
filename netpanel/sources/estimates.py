"""Stored estimates of windows: what is still right is read, the rest is estimated.

Beside each window's rows lies a digest of the input they came from and of the settings, so a window
is fitted again if any of its rows, or the settings, changed, and not otherwise. Only the
folders of windows fitted again are written (dynamic overwrite), estimates before digests. A digest is
kept with the number of estimates it had, and estimates carry their digest: a window is taken as stored
only if all agree, so what a lost job leaves is fitted again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .catalog import listing, scratch, write

DIGEST = "input_digest"


def digests(inputs: DataFrame, key: str, settings: str = "") -> DataFrame:
    """key, input_digest: of each key's rows in any order, with repeats; columns count in the order of their names."""
    columns = sorted(c for c in inputs.columns if c != key)
    # a null leaves a hash as it is, so where nulls stand is hashed too
    parts = [*columns, *[F.col(c).isNull() for c in columns]]
    hashed = inputs.where(F.col(key).isNotNull()).select(key, F.xxhash64(F.lit(0), *parts).alias("_a"), F.xxhash64(F.lit(1), *parts).alias("_b"))
    # upper and lower half are summed apart: whole, without wide decimals
    halves = [F.sum(F.shiftright("_a", 32)).alias("s"), F.sum(F.col("_a").bitwiseAND(F.lit(0xFFFFFFFF))).alias("t")]
    found = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *halves, F.bit_xor("_b").alias("x"))
    return found.select(key, F.sha2(F.concat_ws("|", F.lit(settings), F.lit(",".join(columns)), "n", "s", "t", "x"), 256).alias(DIGEST))


def _stored(spark: SparkSession, path: str, key: StructField) -> DataFrame | None:
    """The rows under a path, None if there are none; the key has its own type, not one guessed from folder names."""
    if not any(n.startswith(f"{key.name}=") for n in listing(spark, path)):
        return None
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != key.name]
    return spark.read.schema(StructType([*fields, key])).parquet(path)


def _counted(marks: DataFrame, held: DataFrame | None, key: str) -> DataFrame:
    """marks with n, the number of stored estimates of their key and digest."""
    if held is None:
        return marks.withColumn("n", F.lit(0).cast("long"))
    n = held.groupBy(key, DIGEST).agg(F.count(F.lit(1)).alias("n"))
    return marks.join(n, [key, DIGEST], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def refresh(inputs: DataFrame, key: str, path: str, estimate: Callable[[DataFrame], DataFrame], settings: str = "") -> tuple[DataFrame, DataFrame]:
    """(estimates, fitted): the estimates of every key of the inputs, and the keys fitted in this call.

    estimate takes rows of the inputs, whole keys only, and returns rows with the key. ``settings``
    names what else it depends on (grids, its version). One program writes to a path at a time.
    Defined cases: a key without estimates is remembered as such; rows with a null key are left out; stored
    keys that the inputs no longer have are not returned."""
    spark = inputs.sparkSession
    field = StructField(key, inputs.schema[key].dataType)
    now = scratch(spark, "digests")
    digests(inputs, key, settings).write.parquet(now)
    current = spark.read.parquet(now)
    known, held = _stored(spark, f"{path}/digests", field), _stored(spark, f"{path}/estimates", field)
    stale = current if known is None else current.join(_counted(known.select(key, DIGEST, "kept"), held, key).where("kept = n"), [key, DIGEST], "left_anti")
    todo = scratch(spark, "stale")  # what it is read from is overwritten below
    stale.write.parquet(todo)
    stale = spark.read.parquet(todo)
    if not stale.isEmpty():
        fitted = estimate(inputs.join(stale.select(key), key, "left_semi"))
        write(fitted.join(stale, key), f"{path}/estimates", [key])
        counts = _counted(stale, _stored(spark, f"{path}/estimates", field), key)
        write(counts.withColumnRenamed("n", "kept"), f"{path}/digests", [key])
    held = _stored(spark, f"{path}/estimates", field)
    if held is None:
        return estimate(inputs.where(F.lit(False))), stale.select(key)
    # rows of another digest are left from a key that has no estimates now, or from a lost job
    return held.join(current, [key, DIGEST], "left_semi").drop(DIGEST), stale.select(key)


def read_or_estimate(inputs: DataFrame, key: str, path: str, estimate: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
    return refresh(inputs, key, path, estimate, settings)[0]
