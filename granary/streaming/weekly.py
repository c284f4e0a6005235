"""Extra: weekly demand of a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_demand(transactions: DataFrame, late: str = "14 days") -> DataFrame:
    """(week, stock_code, weekly_sales) over Monday-to-Sunday windows; rows later than
    ``late`` are dropped. Needs a zoned ``invoice_date`` and the UTC session zone."""
    week = F.window("invoice_date", "7 days", startTime="4 days")
    sums = transactions.withWatermark("invoice_date", late).groupBy(week.alias("w"), "stock_code").agg(F.sum("quantity").alias("weekly_sales"))
    return sums.select((F.col("w.end") - F.expr("interval 1 day")).alias("week"), "stock_code", "weekly_sales")
