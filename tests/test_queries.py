"""Every registered query against its SQL in DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from netpanel.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None or v != v, str(v) if not isinstance(v, float) else f"{v:.4e}") for v in row)


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1.1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(name, spark, duck):
    q = catalogue()[name]
    df = q.run(spark, SF)
    assert df.columns == [n for n, _ in q.columns]
    rows = sorted((tuple(r) for r in df.collect()), key=key)
    if q.sql is None:
        return
    want = sorted(duck.execute(q.sql).fetchall(), key=key)
    assert len(rows) == len(want)
    assert all(same(x, y) for r, w in zip(rows, want, strict=True) for x, y in zip(r, w, strict=True))
