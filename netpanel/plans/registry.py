"""Queries with their DuckDB counterparts.

A query names its result columns with a kind each (``date:d n:i ret:f``); Spark's result
and the SQL are both shaped to it, so that types, rounding and order of columns agree:
d: date as text, s: text, i: 64-bit integer, b: boolean, fN: double rounded to N decimals
(f: 6), with no negative zero; NaN and infinities are null. Before rounding a small fixed amount is added,
so that a value halfway between two decimals (the mean of two prices, say) rounds alike
although the engines sum in different orders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    run: Run
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def _nudge(n: int) -> float:
    return 1.37 * 10.0 ** -(n + 3)


def _shape(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in "ds":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    c = c.cast("double")
    n = int(kind[1:] or 6)
    return (F.round(F.when(F.abs(c) < float("inf"), c) + F.lit(_nudge(n)), n) + 0.0).alias(name)


def _shape_sql(name: str, kind: str) -> str:
    if kind in "ds":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    d = f"CAST({name} AS DOUBLE)"
    n = int(kind[1:] or 6)
    return f"round(CASE WHEN isfinite({d}) THEN {d} END + CAST('{_nudge(n)!r}' AS DOUBLE), {n}) + 0.0 AS {name}"


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a query; ``sql`` is a SELECT, or WITH ... SELECT, over the driver's tables."""
    kinds = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())

    def add(run: Run) -> Run:
        def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir).select(*[_shape(n, k) for n, k in kinds])

        wrapped = None if sql is None else f"SELECT {', '.join(_shape_sql(n, k) for n, k in kinds)} FROM ({sql})"
        assert name not in CATALOGUE, name
        CATALOGUE[name] = Query(name, kinds, shaped, wrapped)
        return run

    return add
