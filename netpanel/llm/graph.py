"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge in (a, b): root is the least node reachable.

    In a large-star step every node links its larger neighbours to its least one, in a
    small-star step its smaller neighbours; both keep components and shrink depths, so
    about log2 of the diameter rounds end in stars. Groups are only ever reduced to a
    minimum, which is written and joined back: so that join reads two plain exchanges, and
    adaptive execution splits the edges of a node that has very many. Each round is written
    to the shared folder."""
    current = materialize(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")), "edges")
    mark = _fingerprint(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, current = current, materialize(_distinct(large.where("a <> b")), "large")
        discard(last, least)
        least = materialize(current.groupBy("a").agg(F.min("b").alias("m")), "least")
        own = current.join(least, "a")
        small = own.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, current = current, materialize(_distinct(small.where("a <> b")), "small")
        discard(last, least)
        new = _fingerprint(current)
        if new == mark:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = new
    raise RuntimeError(f"no stars after {MAX_ROUNDS} rounds")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["a", "b"])


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
