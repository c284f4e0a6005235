"""Revenue by month and best sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import exact_sum


def monthly_revenue(transactions: DataFrame) -> DataFrame:
    """(month_end, revenue) for every month from the first to the last; months without sales have 0.

    Sales are read once: the gaps are filled from each aggregated month up to the next
    one, and months are few, so they pass through one window.
    """
    amount = F.col("quantity") * F.col("unit_price")
    by_month = transactions.where(F.col("invoice_date").isNotNull()).groupBy(F.last_day("invoice_date").alias("own")).agg(exact_sum(amount).alias("revenue"))
    followed = by_month.withColumn("following", F.lead("own").over(Window.orderBy("own")))
    upto = F.coalesce(F.add_months(F.trunc("following", "month"), -1), F.trunc("own", "month"))
    months = followed.select("own", "revenue", F.explode(F.sequence(F.trunc("own", "month"), upto, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.last_day("m").alias("month_end"), F.when(F.last_day("m") == F.col("own"), F.col("revenue")).otherwise(0.0).alias("revenue"))


def top_products(transactions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` descriptions with the greatest quantity; ties by description; null descriptions never."""
    sums = transactions.where(F.col("description").isNotNull()).groupBy("description").agg(F.sum("quantity").alias("total_quantity"))
    return sums.orderBy(F.desc("total_quantity"), "description").limit(n)


def top_skus(sales: DataFrame, n: int = 100, value: str = "quantity") -> DataFrame:
    """The ``n`` stock codes with the greatest sum; the smaller code wins a tie, as text."""
    sums = sales.where(F.col("stock_code").isNotNull()).groupBy("stock_code").agg(F.sum(value).alias("total_quantity"))
    return sums.orderBy(F.desc("total_quantity"), "stock_code").limit(n)
