"""Trend with change points: conditions of the optimum, a planted change, products of few weeks."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from granary.operators import trend


def weeks(spark, sales, share=0.8):
    day = lambda i: datetime.datetime(2020, 1, 5) + datetime.timedelta(days=7 * i)
    rows = [(c, day(i), y, "train" if i < int(len(ys) * share) else "test") for c, ys in sales.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "stock_code string, week timestamp, weekly_sales bigint, part string")
    return df.withColumn("week", F.col("week").cast("timestamp_ntz"))


def test_conditions_of_the_optimum():
    rng = np.random.default_rng(1)
    for n, m in ((60, 25), (24, 18), (9, 6)):
        t = np.linspace(0, 1, n)
        spots = t[np.linspace(1, n * 0.8 - 1, m).astype(int)]
        x = np.column_stack([np.ones(n), t, *(np.maximum(t - s, 0) for s in spots), *(f(2 * np.pi * k * 1.2 * t) for k in range(1, 11) for f in (np.sin, np.cos))])
        y = 0.4 + 0.3 * t - 0.8 * np.maximum(t - 0.5, 0) + rng.normal(0, 0.05, n)
        weights, variance = trend.solve(x, y, m)
        slope = x.T @ (y - x @ weights) / variance
        change = weights[2 : 2 + m]
        pull = slope[2 : 2 + m]
        assert np.all(np.abs(pull) <= (1 + 1e-5) / trend.CHANGE_SCALE)
        assert np.allclose(pull[change != 0], np.sign(change[change != 0]) / trend.CHANGE_SCALE, rtol=1e-4)
        rest = np.r_[0, 1, 2 + m : x.shape[1]]
        prior = np.r_[[trend.TREND_SCALE**-2] * 2, [trend.WAVE_SCALE**-2] * 20]
        assert np.allclose(slope[rest], weights[rest] * prior, atol=1e-5)


def test_a_change_is_found_and_goes_on(spark):
    falls = [20 + 3 * min(i, 60) - 2 * max(i - 60, 0) for i in range(150)]
    got = trend.trend_forecast(weeks(spark, {"a": falls, "b": [7] * 150})).orderBy("stock_code", "week").collect()
    assert len(got) == 60
    assert max(abs(r.prediction - r.weekly_sales) for r in got if r.stock_code == "a") < 12
    assert max(abs(r.prediction - 7) for r in got if r.stock_code == "b") < 0.2


def test_few_weeks(spark):
    """One train week, none at all, constant zero sales."""
    parts = weeks(spark, {"one": [5, 6], "zero": [0] * 10}, 0.5).union(weeks(spark, {"none": [3]}, 0.0))
    got = {(r.stock_code, r.week): r.prediction for r in trend.trend_forecast(parts).collect()}
    assert {k for k, _ in got} == {"one", "zero"} and all(np.isfinite(v) for v in got.values())
    assert all(v == 0 for (c, _), v in got.items() if c == "zero")
