"""Forecasts, chronological splits, metrics and compared models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import round_scaled
from granary.operators import boosting, statespace, trend
from granary.operators.demand import by_product, latest

GROWTH = 0.02
FEATURES = ("lag_1_week", "lag_2_week", "rolling_4_wk_avg", "month")
YEARLY_ORDER = 3
EPSILON = 2.220446049250313e-16
PREDICTED = "stock_code string, week timestamp_ntz, weekly_sales bigint, prediction double"


def horizon_forecast(features: DataFrame, weeks: int = 4, last: int = 4) -> DataFrame:
    """(stock_code, week_horizon, predicted_quantity) for horizons 1..weeks of each product:
    the mean of its latest weeks, growing by 2 % of itself a week, not below zero, to two places.
    No rows if ``weeks`` is below one."""
    recent = latest(features, last).groupBy("stock_code").agg(F.avg("weekly_sales").alias("mean"))
    if weeks < 1:
        return recent.select("stock_code", F.lit(1).alias("week_horizon"), F.col("mean").alias("predicted_quantity")).limit(0)
    ahead = recent.select("stock_code", "mean", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week_horizon"))
    value = F.greatest(F.lit(0.0), F.col("mean") * (1.0 + GROWTH * F.col("week_horizon")))
    return ahead.select("stock_code", "week_horizon", round_scaled(value).alias("predicted_quantity"))


def split(features: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``part``: train for each product's first floor(n * share) weeks, else test."""
    weeks = Window.partitionBy("stock_code")
    nth = F.row_number().over(weeks.orderBy("week"))
    return features.withColumn("part", F.when(nth <= F.floor(F.count("*").over(weeks) * F.lit(float(share))), "train").otherwise("test"))


def metrics(predicted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """mape (ratio; the denominator is at least the smallest rounding step) and rmse."""
    y, p = F.col("weekly_sales").cast("double"), F.col("prediction")
    return predicted.groupBy(*keys).agg(F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"), F.sqrt(F.avg(F.pow(y - p, F.lit(2.0)))).alias("rmse"))


def _tree_rows(parts: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(parts)


def fit_boosted_trees(parts: DataFrame):
    """Spark's first-order boosted trees on the lag features of the train part; a model that Spark can write and load."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol="weekly_sales", maxIter=100, stepSize=0.05, maxDepth=4, seed=42).fit(_tree_rows(parts).where("part = 'train'"))


def tree_predictions(model, parts: DataFrame) -> DataFrame:
    """Predictions of fitted trees on the test part."""
    return model.transform(_tree_rows(parts).where("part = 'test'")).select("stock_code", "week", "weekly_sales", "prediction")


def boosted_trees(parts: DataFrame) -> DataFrame:
    """Predictions on each product's test part by second-order boosted trees of its train part."""
    return boosting.predict_products(boosting.fit_products(parts), parts.where("part = 'test'"))


def _sarima_residuals(w: np.ndarray, phi: np.ndarray, seasonal: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Residuals of (1 - phi B)(1 - seasonal B^4) w = (1 + theta B) e, those before the start
    being 0: a row of them for each of the coefficients, which are arrays."""
    past = lambda k: np.concatenate((np.zeros(k), w[:-k]))[: len(w)]
    phi, seasonal = phi[:, None], seasonal[:, None]
    e = w - phi * past(1) - seasonal * past(4) + phi * seasonal * past(5)
    for t in range(1, len(w)):
        e[:, t] -= theta * e[:, t - 1]
    return e


def sarima(y: np.ndarray, steps: int, coefficients: tuple[float, float, float] | None = None) -> np.ndarray:
    """Forecast of a (1,1,1)(1,1,0,4) model, fitted by conditional least squares unless
    its ``coefficients`` (phi, seasonal, theta) are given.

    The three coefficients are searched on a grid that is refined around the best
    point. Series too short to difference are continued by their last value.
    """
    y = np.asarray(y, float)
    if len(y) < 7:
        return np.full(steps, y[-1] if len(y) else 0.0)
    d = np.diff(y)
    w = d[4:] - d[:-4]
    best, width = np.array(coefficients or (0.0, 0.0, 0.0)), 0.9
    for _ in range(0 if coefficients else 6):
        axes = np.clip(best[:, None] + width * np.array([-1, -0.5, 0, 0.5, 1]), -0.95, 0.95)
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        best = grid[(_sarima_residuals(w, *grid.T) ** 2).sum(1).argmin()]
        width /= 2
    phi, seasonal, theta = best
    e = _sarima_residuals(w, *best[:, None])[0, -1]
    w, out = list(w), list(y)
    for _ in range(steps):
        at = lambda k: w[-k] if len(w) >= k else 0.0
        w.append(phi * at(1) + seasonal * at(4) - phi * seasonal * at(5) + theta * e)
        e = 0.0
        out.append(out[-1] + (out[-4] - out[-5]) + w[-1])
    return np.array(out[len(y) :])


def yearly_terms(parts: DataFrame, order: int = YEARLY_ORDER) -> DataFrame:
    """Adds ``terms``: 1, years since the product's first train week, and yearly sine and cosine waves."""
    first = F.min(F.when(F.col("part") == "train", F.col("week"))).over(Window.partitionBy("stock_code"))
    t = F.timestamp_diff("SECOND", first, F.col("week")) / (365.25 * 86400)
    timed = parts.withColumn("t", t)
    waves = [f(2 * math.pi * k * F.col("t")) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return timed.withColumn("terms", F.array(F.lit(1.0), F.col("t"), *waves)).drop("t")


def normal_equations(termed: DataFrame) -> DataFrame:
    """(stock_code, i, j, value) of each product's train part: sums of term i times term j
    for i <= j, and of term i times the sales as j = -1."""
    pairs = F.transform("terms", lambda x, i: F.struct(i.alias("i"), F.lit(-1).alias("j"), (x * F.col("weekly_sales")).alias("v")))
    squares = F.flatten(F.transform("terms", lambda x, i: F.transform(F.slice("terms", i + 1, F.size("terms")), lambda y, j: F.struct(i.alias("i"), (i + j).alias("j"), (x * y).alias("v")))))
    rows = termed.where("part = 'train'").select("stock_code", F.explode(F.concat(pairs, squares)).alias("p")).select("stock_code", "p.*")
    return rows.groupBy("stock_code", "i", "j").agg(F.sum("v").alias("value"))


def yearly_weights(equations: DataFrame, ridge: float = 1.0) -> DataFrame:
    """(stock_code, weights): each product's ridge solution of its normal equations; trend and level are as good as free."""

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows.i.max()) + 1
        a, b = np.zeros((n, n)), np.zeros(n)
        square = rows[rows.j >= 0]
        a[square.i, square.j] = a[square.j, square.i] = square.value
        right = rows[rows.j < 0]
        b[right.i] = right.value
        keep = np.full(n, ridge)
        keep[:2] = 1e-6
        return pd.DataFrame({"stock_code": [rows.stock_code.iloc[0]], "weights": [np.linalg.solve(a + np.diag(keep), b)]})

    return equations.groupBy("stock_code").applyInPandas(solved, "stock_code string, weights array<double>")


def _by_product(parts: DataFrame, predict) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week")
        train, test = rows[rows.part == "train"], rows[rows.part == "test"]
        if train.empty or test.empty:
            return pd.DataFrame(columns=["stock_code", "week", "weekly_sales", "prediction"])
        return test[["stock_code", "week", "weekly_sales"]].assign(prediction=np.asarray(predict(train, test), float))

    return by_product(parts.select("stock_code", "week", "weekly_sales", "part")).groupBy("stock_code").applyInPandas(run, PREDICTED)


def sarima_forecast(parts: DataFrame) -> DataFrame:
    """Predictions on each product's test part by a seasonal ARIMA of its train part, fitted by maximum likelihood."""
    return _by_product(parts, lambda train, test: statespace.forecast(train.weekly_sales.to_numpy(), len(test)))


def sarima_likelihood(parts: DataFrame, coefficients: tuple[float, float, float] | None = None) -> DataFrame:
    """(stock_code, phi, seasonal, theta, variance, log_likelihood) of the differenced train part of each
    product that can be differenced, at given coefficients or at those of the greatest likelihood."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w = statespace.differenced(rows.sort_values("week").weekly_sales.to_numpy())
        if not len(w):
            return pd.DataFrame(columns=["stock_code", "phi", "seasonal", "theta", "variance", "log_likelihood"])
        found = coefficients or statespace.fit(w)
        value, variance, *_ = statespace.filtered(w, *found)
        return pd.DataFrame([(rows.stock_code.iloc[0], *found, variance[0], value[0])], columns=["stock_code", "phi", "seasonal", "theta", "variance", "log_likelihood"])

    train = parts.where("part = 'train'").select("stock_code", "week", "weekly_sales")
    return by_product(train).groupBy("stock_code").applyInPandas(run, "stock_code string, phi double, seasonal double, theta double, variance double, log_likelihood double")


def sarima_path(parts: DataFrame, coefficients: tuple[float, float, float]) -> DataFrame:
    """Forecasts by the conditional recursion, with given coefficients (phi, seasonal, theta)."""
    return _by_product(parts, lambda train, test: sarima(train.weekly_sales.to_numpy(), len(test), coefficients))


def sarima_by_models(parts: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions on each product's test part by stored coefficients (stock_code, phi, seasonal, theta),
    joined by product; products without a model go on with their last value."""

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week")
        train, test = rows[rows.part == "train"], rows[rows.part == "test"]
        if train.empty or test.empty:
            return pd.DataFrame(columns=["stock_code", "week", "weekly_sales", "prediction"])
        found = tuple(map(float, model[["phi", "seasonal", "theta"]].iloc[0])) if len(model) else (0.0, 0.0, 0.0)
        y = train.weekly_sales.to_numpy(float)
        ahead = statespace.forecast(y if len(model) else y[-1:], len(test), found)
        return test[["stock_code", "week", "weekly_sales"]].assign(prediction=ahead)

    own = parts.select("stock_code", "week", "weekly_sales", "part")
    return own.groupBy("stock_code").cogroup(models.groupBy("stock_code")).applyInPandas(run, PREDICTED)


def yearly_forecast(parts: DataFrame) -> DataFrame:
    """Predictions on each product's test part by a linear trend and yearly waves, fitted
    by ridge regression on its train part. Only the solution of the normal equations of a
    product, a matrix of eight rows, is Python."""
    termed = yearly_terms(parts)
    weights = yearly_weights(normal_equations(termed))
    value = F.aggregate(F.zip_with("terms", "weights", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return termed.where("part = 'test'").join(weights, "stock_code").select("stock_code", "week", "weekly_sales", value.alias("prediction"))


def lag_forecast(parts: DataFrame) -> DataFrame:
    """The week before as prediction."""
    return parts.where("part = 'test'").select("stock_code", "week", "weekly_sales", F.col("lag_1_week").alias("prediction"))


MODELS = {"SARIMA_Baseline": sarima_forecast, "Yearly_Trend": trend.trend_forecast, "Boosted_Trees": boosted_trees}


def compared(parts: DataFrame) -> DataFrame:
    """(run_name, mape, rmse) of every model on the given products."""
    runs = [metrics(predict(parts)).select(F.lit(name).alias("run_name"), "mape", "rmse") for name, predict in MODELS.items()]
    return runs[0].union(runs[1]).union(runs[2])
