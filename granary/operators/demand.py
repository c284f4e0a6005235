"""Weekly demand per product and its features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.calendar import week_ending

TOP = 100


def weekly_demand(transactions: DataFrame, top: int = TOP) -> DataFrame:
    """(week, stock_code, weekly_sales) of the ``top`` products; weeks without sales have no row.

    One pass over the sales sums quantities by product and week; products are ranked
    by the sums of these, ties by the smaller code, and the ``top`` codes, a broadcast
    of so many rows at most, keep their weeks. Both sides of the join read the same
    aggregate and reuse its exchange, which holds partial sums, never sales. For that
    they need the same columns, and no filter on a key that would be pushed below one
    side: sales without a date count for the rank and have no week, and go by the
    comparison of dates.
    """
    sold = transactions.where(F.col("stock_code").isNotNull() & F.col("quantity").isNotNull())
    weekly = sold.groupBy("stock_code", week_ending("invoice_date").alias("week")).agg(F.sum("quantity").cast("long").alias("weekly_sales"), F.max("invoice_date").alias("dated"))
    sums = weekly.groupBy("stock_code").agg(F.sum("weekly_sales").alias("total"), F.max("dated").alias("latest"))
    best = sums.orderBy(F.desc("total"), "stock_code").limit(top).select(F.col("stock_code").alias("best"), "latest")
    kept = weekly.join(F.broadcast(best), (F.col("stock_code") == F.col("best")) & (F.col("dated") <= F.col("latest")))
    return kept.select("week", "stock_code", "weekly_sales")


def with_empty_weeks(weekly: DataFrame) -> DataFrame:
    """Extra: a row with 0 for every week between a product's first and last."""
    spans = weekly.groupBy("stock_code").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    spine = spans.select("stock_code", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return spine.join(weekly, ["stock_code", "week"], "left").select("week", "stock_code", F.coalesce("weekly_sales", F.lit(0).cast("long")).alias("weekly_sales"))


def features(weekly: DataFrame) -> DataFrame:
    """Lags of one and two observed weeks, mean of up to four earlier weeks, month of the
    week's Sunday. Rows without both lags go, so a product's first two weeks do."""
    weeks = Window.partitionBy("stock_code").orderBy("week")
    return weekly.select(
        "week", "stock_code", "weekly_sales",
        F.lag("weekly_sales", 1).over(weeks).cast("double").alias("lag_1_week"), F.lag("weekly_sales", 2).over(weeks).cast("double").alias("lag_2_week"),
        F.avg("weekly_sales").over(weeks.rowsBetween(-4, -1)).alias("rolling_4_wk_avg"), F.month("week").alias("month"),
    ).na.drop("any")


def weekly_features(transactions: DataFrame, top: int = TOP) -> DataFrame:
    return features(weekly_demand(transactions, top))


def latest(features_: DataFrame, n: int = 4) -> DataFrame:
    """Each product's ``n`` latest weeks."""
    rank = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("week")))
    return features_.withColumn("nth", rank).where(F.col("nth") <= n)


def top_sku(features_: DataFrame) -> DataFrame:
    """The product with the greatest sum of weekly sales; the smaller code wins a tie."""
    sums = features_.groupBy("stock_code").agg(F.sum("weekly_sales").alias("total_sales"))
    return sums.orderBy(F.desc("total_sales"), "stock_code").limit(1)


def by_product(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by product to as many tasks as the session has for a shuffle. A fit is dear
    however few its rows are, so these tasks must not be merged for their small size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stock_code")
