"""Answers for single keys, and the same for all keys as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import round_exact
from granary.operators.customers import next_action
from granary.operators.forecasting import horizon_forecast


class NotFound(LookupError):
    """No row for the key that was asked for."""


def health() -> dict[str, str]:
    return {"status": "healthy", "message": "Retail analytics are ready."}


def forecasts(features: DataFrame, weeks: int = 4) -> DataFrame:
    """stock_code, forecast_horizon_weeks, predictions (array of structs) of every product."""
    step = F.struct("week_horizon", "predicted_quantity")
    ahead = horizon_forecast(features, weeks).groupBy("stock_code").agg(F.array_sort(F.collect_list(step)).alias("predictions"))
    return ahead.select("stock_code", F.lit(weeks).alias("forecast_horizon_weeks"), "predictions")


def forecast(features: DataFrame, stock_code: str, horizon_weeks: int = 4) -> dict:
    """Forecast of one product; NotFound if it has no feature rows."""
    if not isinstance(stock_code, str) or not isinstance(horizon_weeks, int):
        raise TypeError("stock_code is a text, horizon_weeks an integer")
    rows = features.where(F.col("stock_code") == F.lit(stock_code)).select("stock_code", "week", "weekly_sales")
    found = horizon_forecast(rows, max(horizon_weeks, 1)).orderBy("week_horizon").collect()
    if not found:
        raise NotFound(f"no weekly features of product {stock_code!r}")
    steps = [{"week_horizon": r.week_horizon, "predicted_quantity": r.predicted_quantity} for r in found if r.week_horizon <= horizon_weeks]
    return {"stock_code": stock_code, "forecast_horizon_weeks": horizon_weeks, "predictions": steps}


def known(features: DataFrame, codes: DataFrame) -> DataFrame:
    """Each of ``codes`` (stock_code) with ``found``, whether it has feature rows."""
    have = features.select("stock_code").distinct().withColumn("found", F.lit(True))
    return codes.select("stock_code").join(have, "stock_code", "left").select("stock_code", F.coalesce("found", F.lit(False)).alias("found"))


def segments(stored: DataFrame) -> DataFrame:
    """customer_id, metrics and segmentation (structs) of every customer."""
    metrics = F.struct(F.col("recency").cast("int").alias("days_since_last_purchase"), F.col("frequency").cast("int").alias("total_lifetime_orders"), round_exact(F.col("monetary")).alias("total_monetary_spend"))
    return stored.select("customer_id", metrics.alias("metrics"), F.struct(F.col("segment_label").alias("assigned_bucket"), next_action(F.col("segment_label")).alias("strategic_next_action")).alias("segmentation"))


def segment(stored: DataFrame, customer_id: float) -> dict:
    """Segment of one customer; NotFound if there is none. Money is rounded as a Python float."""
    row = stored.where(F.col("customer_id") == F.lit(float(customer_id))).select("*", next_action(F.col("segment_label")).alias("action")).first()
    if row is None:
        raise NotFound(f"no segment of customer {float(customer_id)}")
    return {
        "customer_id": float(customer_id),
        "metrics": {"days_since_last_purchase": int(row.recency), "total_lifetime_orders": int(row.frequency), "total_monetary_spend": round(float(row.monetary), 2)},
        "segmentation": {"assigned_bucket": row.segment_label, "strategic_next_action": row.action},
    }
