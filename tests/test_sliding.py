"""Samples from monthly states against the same characteristics of copied rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from netpanel.operators import panel as P
from netpanel.operators import sampling as S
from netpanel.operators import sliding as SL

MONTHS = 4


@pytest.fixture(scope="module")
def rows(spark):
    """Daily rows with gaps of days and of months, missing values, assets that change company, end early or come late."""
    rng = np.random.default_rng(8)
    made = []
    for k in range(12):
        first, last = (0, 10) if k < 8 else (int(rng.integers(0, 5)), int(rng.integers(5, 11)))
        for m in range(first, last):
            if k % 5 == 2 and m in (3, 4, 5, 6, 7):
                continue
            for day in sorted(rng.choice(np.arange(1, 29), 9, replace=False).tolist()) if k % 4 == 3 else range(1, 29, 3):
                company = 100 + (k // 2 if k != 6 or m < 5 else 1)
                some = lambda x, p=0.02: None if rng.random() < p else float(x)
                made.append((dt.date(2003 + (m + 8) // 12, (m + 8) % 12 + 1, day), k, company, f"T{k}{m // 4}", some(rng.random() * 100), some(rng.standard_normal(), 0.001), None if k == 9 else some(rng.random()), some(rng.random())))
    return spark.createDataFrame(made, "date date, permno long, permco long, ticker string, mcap double, ret double, var double, noisevar double").cache()


def equal(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], rel=1e-12)


def test_summary_equals_that_of_copied_rows(rows):
    want = S.summary(S.representative(P.rolling_samples(S.company_sums(rows), MONTHS)), P.forward_samples(rows, MONTHS))
    got = SL.summary(rows, MONTHS)
    assert got.columns == want.columns
    key = ["sampling_date", "permno"]
    equal([tuple(r) for r in got.orderBy(*key).collect()], [tuple(r) for r in want.orderBy(*key).collect()])


def test_sample_panel_equals_copied_rows_joined_with_the_choice(rows):
    past, ahead, chosen = SL.sample_panel(rows, MONTHS, 3)
    held = chosen.select("sampling_date", "permno", "asset_order")
    want = S.representative(P.rolling_samples(S.company_sums(rows), MONTHS)).join(held, ["sampling_date", "permno"])
    want_ahead = P.forward_samples(rows, MONTHS).join(held, ["sampling_date", "permno"])
    for got, copied in ((past, want), (ahead, want_ahead)):
        assert sorted(got.columns) == sorted(copied.columns)
        order = ["sampling_date", "date", "permno"]
        cols = sorted(copied.columns)
        equal([tuple(r) for r in got.orderBy(*order).select(*cols).collect()], [tuple(r) for r in copied.orderBy(*order).select(*cols).collect()])


def test_rows_are_not_copied_and_an_empty_panel_has_no_samples(rows):
    plan = SL.summary(rows, MONTHS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 6  # gaps and days seen, of states
    assert SL.summary(rows.limit(0), MONTHS).count() == 0
    assert SL.states(rows).agg(F.max(F.size("vars")).alias("n")).first().n <= 10
