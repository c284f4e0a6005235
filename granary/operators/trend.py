"""Piecewise-linear trend with yearly waves, slope changes under an absolute penalty.

Terms of a product's week are one, its time (0 to 1 over the train weeks), how far it lies
beyond each change point, and yearly sine and cosine waves. Change points are train weeks
at even places of the first part of them. Sales, as shares of the greatest, are fitted to
the terms at the greatest posterior: Laplace priors on slope changes, normal ones on the
rest, and the noise from the residuals. The terms are columns; only the solution, from
products of terms with terms and with sales, is numpy, for one product at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.demand import by_product

CHANGES, CHANGE_SHARE, WAVES = 25, 0.8, 10
#: Scales of the priors: slope changes, waves, level and slope.
CHANGE_SCALE, WAVE_SCALE, TREND_SCALE = 0.05, 10.0, 5.0
YEAR_DAYS = 365.25
PREDICTED = "stock_code string, week timestamp_ntz, weekly_sales bigint, prediction double"


def _days(week: str) -> Column:
    """Days since 1970, with their parts."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(week)) / F.lit(86400.0)


def trend_terms(parts: DataFrame, changes: int = CHANGES, share: float = CHANGE_SHARE, waves: int = WAVES) -> DataFrame:
    """Adds ``terms`` and ``n_changes``, the number of those that are about change points.

    A product has a row a week at most, so the array of its train weeks is short. Products
    without train weeks have null terms.
    """
    own = Window.partitionBy("stock_code")
    day = _days("week")
    train = F.array_sort(F.collect_list(F.when(F.col("part") == "train", day)).over(own))
    timed = parts.withColumn("days", train)
    first, span = F.element_at("days", 1), F.element_at("days", -1) - F.element_at("days", 1)
    time = lambda d: F.when(span > 0, (d - first) / span).otherwise(0.0)
    early = F.floor(F.size("days") * F.lit(float(share))).cast("int")
    n = F.greatest(F.least(F.lit(changes), early - 1), F.lit(0))
    placed = timed.where("size(days) > 0").withColumn("t", time(day)).withColumn("early", early).withColumn("n_changes", n)
    each = F.when(F.col("n_changes") > 0, F.sequence(F.lit(1), F.col("n_changes"))).otherwise(F.array().cast("array<int>"))
    spot = lambda j: F.get("days", F.floor(j * (F.col("early") - 1) / F.col("n_changes") + 0.5).cast("int"))
    beyond = F.transform(each, lambda j: F.greatest(F.col("t") - time(spot(j)), F.lit(0.0)))
    angles = [f(2 * math.pi * k * day / YEAR_DAYS) for k in range(1, waves + 1) for f in (F.sin, F.cos)]
    return placed.withColumn("terms", F.concat(F.array(F.lit(1.0), F.col("t")), beyond, F.array(*angles))).drop("days", "t", "early")


def lasso(a: np.ndarray, b: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """The least of x'ax / 2 - b'x + penalty * |x|, a coordinate after the other until they stay."""
    x, diagonal = start.copy(), np.diag(a)
    gradient = b - a @ x
    for _ in range(5000):
        most = 0.0
        for j in range(len(x)):
            if diagonal[j] > 1e-12:
                z = gradient[j] + diagonal[j] * x[j]
                step = math.copysign(max(abs(z) - penalty, 0.0), z) / diagonal[j] - x[j]
                if step:
                    x[j] += step
                    gradient -= a[:, j] * step
                    most = max(most, abs(step) * math.sqrt(diagonal[j]))
        if most < 1e-10:
            break
    return x


def solve(terms: np.ndarray, y: np.ndarray, n_changes: int, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights of the terms at the greatest posterior, and the variance of the noise they were found for.

    All but the slope changes have quadratic penalties and are eliminated from the normal
    equations; the slope changes are then found by coordinates.
    """
    a, b = terms.T @ terms, terms.T @ y
    change = np.arange(2, 2 + n_changes)
    rest = np.setdiff1d(np.arange(terms.shape[1]), change)
    precision = np.where(rest < 2, TREND_SCALE**-2, WAVE_SCALE**-2)
    weights, variance = np.zeros(terms.shape[1]), max(float(np.var(y)), 1e-8)
    for turn in range(rounds):
        if turn:
            found = max(float(np.mean((y - terms @ weights) ** 2)), 1e-8)
            if abs(found - variance) < 1e-9 * variance:
                break
            variance = found
        own = a[np.ix_(rest, rest)] + np.diag(variance * precision)
        across = np.linalg.solve(own, np.column_stack([a[np.ix_(rest, change)], b[rest]]))
        reduced = a[np.ix_(change, change)] - a[np.ix_(change, rest)] @ across[:, :-1]
        weights[change] = lasso(reduced, b[change] - a[np.ix_(change, rest)] @ across[:, -1], variance / CHANGE_SCALE, weights[change])
        weights[rest] = across[:, -1] - across[:, :-1] @ weights[change]
    return weights, variance


def trend_forecast(parts: DataFrame) -> DataFrame:
    """Predictions on each product's test part by trend and waves of its train part. The last slope goes on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        train, test = rows[rows.part == "train"], rows[rows.part == "test"]
        scale = max(1e-9, float(train.weekly_sales.abs().max()))
        x, y = (np.stack(list(train.terms)), train.weekly_sales.to_numpy(float) / scale)
        weights, _ = solve(x, y, int(rows.n_changes.iloc[0]))
        ahead = np.stack(list(test.terms)) @ weights * scale if len(test) else np.zeros(0)
        return test[["stock_code", "week", "weekly_sales"]].assign(prediction=ahead)

    termed = trend_terms(parts).select("stock_code", "week", "weekly_sales", "part", "terms", "n_changes")
    return by_product(termed).groupBy("stock_code").applyInPandas(run, PREDICTED)
