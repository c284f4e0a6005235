"""Retail queries by name; each takes (spark, folder of tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import serving
from granary.functions.calendar import week_ending
from granary.operators import boosting, customers, demand, forecasting, revenue, trend
from granary.operators.cleaning import clean, counted, net_of_cancellations, with_amount
from granary.operators.numbering import numbered
from granary.plans.sql import CENTERS, COEFFICIENTS, STEPS
from granary.schemas import TRANSACTIONS
from granary.sources import registry, sinks
from granary.sources.sales import star_sales, stored
from granary.tables import dropped, written

DEMAND = ("Invoice", "StockCode", "Quantity", "InvoiceDate", "Price", "Customer ID")
SPEND = ("Invoice", "Quantity", "InvoiceDate", "Price", "Customer ID")


def transactions(spark: SparkSession, folder: str, columns: tuple[str, ...] = DEMAND) -> DataFrame:
    return clean(star_sales(spark, folder, columns))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return demand.weekly_features(transactions(spark, folder))


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    return customers.rfm(transactions(spark, folder, SPEND))


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    return customers.nearest(customers.scaled(_rfm(spark, folder)), CENTERS)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return customers.labelled(_clustered(spark, folder))


def _top_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Split features of the product with most sales.

    Models are fitted by many passes and three of them read these rows, so they are
    held as a local relation: one product has at most one row a calendar week.
    """
    rows = _features(spark, folder)
    top = demand.top_sku(rows).select(F.col("stock_code").alias("top"))
    parts = forecasting.split(rows.join(F.broadcast(top), F.col("stock_code") == F.col("top")).drop("top"))
    return spark.createDataFrame(parts.collect(), parts.schema)


def clean_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return with_amount(clean(star_sales(spark, folder)))


def monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.monthly_revenue(transactions(spark, folder, SPEND))


def top10_products(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.top_products(transactions(spark, folder, ("Invoice", "Description", "Quantity", "Price", "Customer ID")))


def top100_skus(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.top_skus(transactions(spark, folder, ("Invoice", "StockCode", "Quantity", "Price", "Customer ID")))


def weekly_demand(spark: SparkSession, folder: str) -> DataFrame:
    return demand.weekly_demand(transactions(spark, folder))


def dense_weekly_demand(spark: SparkSession, folder: str) -> DataFrame:
    return demand.with_empty_weeks(weekly_demand(spark, folder))


def top_sku(spark: SparkSession, folder: str) -> DataFrame:
    return demand.top_sku(_features(spark, folder))


def sku_history_latest4(spark: SparkSession, folder: str) -> DataFrame:
    return demand.latest(_features(spark, folder)).select("stock_code", "week", "weekly_sales", "nth")


def forecast_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.horizon_forecast(_features(spark, folder), 12)


def forecast_responses(spark: SparkSession, folder: str) -> DataFrame:
    rows = serving.forecasts(_features(spark, folder), 4)
    return rows.select("stock_code", "forecast_horizon_weeks", F.array_join(F.transform("predictions", lambda p: F.concat_ws(":", p["week_horizon"], F.format_string("%.2f", p["predicted_quantity"]))), ",").alias("predictions"))


def rfm_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", "ts", "value")
    return customers.profiles(events, "user_id", "event_type", "ts", F.col("value"))


def weekly_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_type")
    return events.groupBy(week_ending("ts").alias("week"), "event_type").agg(F.count("*").alias("n"))


def rfm_scaled(spark: SparkSession, folder: str) -> DataFrame:
    rows = customers.scaled(_rfm(spark, folder))
    return rows.select("customer_id", *(F.round(f"z_{m}", 6).alias(f"z_{m}") for m in customers.METRICS))


def assign_fixed_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return _clustered(spark, folder).select("customer_id", "cluster")


def label_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return customers.cluster_labels(_clustered(spark, folder)).select("cluster", F.round("mean_monetary", 2).alias("mean_monetary"), "segment_label")


def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = customers.segment_summary(_segments(spark, folder))
    return rows.select("segment_label", *(F.round(m, 4).alias(m) for m in customers.METRICS), "customer_count")


def segment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _segments(spark, folder).where(F.col("customer_id") == F.lit(7.0))
    return rows.select("customer_id", "recency", "frequency", "monetary", "segment_label", customers.next_action(F.col("segment_label")).alias("strategic_next_action"))


def segment_actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = serving.segments(_segments(spark, folder))
    return rows.select("customer_id", "metrics.days_since_last_purchase", "metrics.total_lifetime_orders", "segmentation.assigned_bucket", "segmentation.strategic_next_action", "metrics.total_monetary_spend")


def net_quantities(spark: SparkSession, folder: str) -> DataFrame:
    return net_of_cancellations(star_sales(spark, folder, ("Invoice", "StockCode", "Quantity")))


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.split(_features(spark, folder)).select("stock_code", "week", "weekly_sales", "part")


def naive_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = forecasting.metrics(forecasting.lag_forecast(forecasting.split(_features(spark, folder))), ("stock_code",))
    return rows.select("stock_code", F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"))


def k_means_segments(spark: SparkSession, folder: str) -> DataFrame:
    return customers.k_means_segments(transactions(spark, folder, SPEND))


def gbt_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.boosted_trees(forecasting.split(_features(spark, folder)))


def boosted_first_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Splits and leaves of every product's first tree."""
    nodes = boosting.fit_products(forecasting.split(_features(spark, folder)), boosting.Boosting(trees=1)).where("tree = 0")
    return nodes.select("stock_code", "node", "feature", F.round("cut", 6).alias("cut"), F.round("value", 6).alias("value"), "n")


def sarima_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.sarima_forecast(forecasting.split(_features(spark, folder)))


def yearly_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.yearly_forecast(forecasting.split(_features(spark, folder)))


def trend_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return trend.trend_forecast(forecasting.split(_features(spark, folder)))


def trend_design(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of trend, slope changes and waves of every product's weeks."""
    rows = trend.trend_terms(forecasting.split(_features(spark, folder)))
    return rows.select("stock_code", "week", "n_changes", F.posexplode("terms").alias("i", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return forecasting.compared(_top_parts(spark, folder))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counted(star_sales(spark, folder, ("Invoice", "Quantity", "Price", "Customer ID")))


def projected_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder, SPEND).select("customer_id", "invoice_no", "invoice_date", "quantity", "unit_price")


def inline_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows given in the program, the labels with their actions, joined to the segments that customers are in."""
    given = spark.createDataFrame([(i, label, customers.ACTIONS[label]) for i, label in enumerate(customers.LABELS)], "step int, segment_label string, strategic_next_action string")
    found = _segments(spark, folder).groupBy("segment_label").agg(F.count("*").alias("n"))
    return given.join(found, "segment_label", "left").select("step", "segment_label", "strategic_next_action", F.coalesce("n", F.lit(0).cast("long")).alias("customers"))


def known_products(spark: SparkSession, folder: str) -> DataFrame:
    """Whether products have features, the test that an answer for one of them begins with."""
    codes = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").cast("string").alias("stock_code"))
    return serving.known(_features(spark, folder), codes)


def ordered_features(spark: SparkSession, folder: str) -> DataFrame:
    """All stored features in the order of weeks (and products), with each row's position in it."""
    name = f"ordered_{uuid.uuid4().hex}"
    sinks.replace_table(_features(spark, folder), name)
    rows = numbered(stored(spark, name), ["week", "stock_code"])
    spark.sql(f"DROP TABLE {name}")
    return rows.select("position", "week", "stock_code", "weekly_sales")


def keyed_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with a key of their own, 1, 2, 3... in the order of invoices and lines."""
    columns = ["invoice_no", "stock_code", "quantity", "unit_price", "customer_id", "invoice_date"]
    return numbered(transactions(spark, folder).select(*columns), columns, "id")


def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers for one customer and one product from tables stored by key, of which only the key's bucket is read."""
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("segments", "features")]
    sinks.store_by_key(_segments(spark, folder), names[0], "customer_id")
    sinks.store_by_key(_features(spark, folder), names[1], "stock_code")
    top = demand.top_sku(stored(spark, names[1])).first().stock_code
    who, ahead = serving.segment(stored(spark, names[0]), 7.0), serving.forecast(stored(spark, names[1]), top, 4)
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    rows = [("segment", "7", 0, who["segmentation"]["assigned_bucket"], who["metrics"]["total_monetary_spend"])]
    rows += [("forecast", top, p["week_horizon"], None, p["predicted_quantity"]) for p in ahead["predictions"]]
    return spark.createDataFrame(rows, "answer string, key string, step int, label string, value double")


def repeated_append(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and quantity of a stored table after the same batch came twice, and then with new sales."""
    name, rows, found = f"ledger_{uuid.uuid4().hex}", written(clean(star_sales(spark, folder)), "sales"), []
    for step, batch in (("first", rows.where("quantity <= 25")), ("again", rows.where("quantity <= 25")), ("more", rows.where("quantity > 25"))):
        added = sinks.append_once(batch, name)
        r = sinks.appended(spark, name).agg(F.count("*").alias("n"), F.sum("quantity").alias("total_quantity")).first()
        found.append((step, added, r.n, r.total_quantity))
    sinks.drop_appended(spark, name)
    dropped(rows)
    return spark.createDataFrame(found, "step string, added boolean, n bigint, total_quantity bigint")


def features_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The first five rows by product and week."""
    return _features(spark, folder).orderBy("stock_code", "week").limit(5)


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and quantity of a stored table of transactions after it is created, appended to twice, and replaced."""
    name = f"transactions_{uuid.uuid4().hex}"
    rows = written(clean(star_sales(spark, folder)), "sales")
    found = []

    def look(step: str) -> None:
        r = stored(spark, name, ["quantity"]).agg(F.count("*").alias("n"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_quantity")).first()
        found.append((step, r.n, r.total_quantity))

    sinks.create_if_missing(spark, name, TRANSACTIONS)
    look("created")
    sinks.create_if_missing(spark, name, TRANSACTIONS)
    sinks.append_table(rows, name)
    look("appended")
    sinks.append_table(rows, name)
    look("appended again")
    sinks.replace_table(rows.where("quantity > 25"), name)
    look("replaced")
    spark.sql(f"DROP TABLE {name}")
    dropped(rows)
    return spark.createDataFrame(found, "step string, n bigint, total_quantity bigint")


def k_means_fixed_start(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters after so many steps from given centers: their size and cost."""
    centers, points = customers.lloyd(written(customers.scaled(_rfm(spark, folder)), "scaled"), CENTERS, STEPS)
    return customers.cost(points, centers).select("cluster", "customer_count", F.round("cost", 4).alias("cost"))


def sarima_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = forecasting.sarima_path(forecasting.split(_features(spark, folder)), COEFFICIENTS)
    return rows.withColumn("prediction", F.round("prediction", 6))


def sarima_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    rows = forecasting.sarima_likelihood(forecasting.split(_features(spark, folder)), COEFFICIENTS)
    return rows.select("stock_code", F.round("variance", 4).alias("variance"), F.round("log_likelihood", 5).alias("log_likelihood"))


def yearly_normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    rows = forecasting.normal_equations(forecasting.yearly_terms(forecasting.split(_features(spark, folder))))
    return rows.select("stock_code", "i", "j", F.round("value", 5).alias("value"))


def saved_model_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the seasonal model and of the boosted trees of all products: their models stored
    as rows, and their metrics from those rows read back, the latest run of each kind."""
    parts = written(forecasting.split(_features(spark, folder)), "parts")
    test, runs, nodes, coefficients = parts.where("part = 'test'"), *(f"{kind}_{uuid.uuid4().hex}" for kind in ("runs", "nodes", "coefficients"))
    for trees in (20, 100):
        how = boosting.Boosting(trees=trees)
        run = registry.save(boosting.fit_products(parts, how), nodes)
        m = forecasting.metrics(boosting.predict_products(registry.model(spark, nodes, run), test)).first()
        registry.log(spark, runs, run, "Boosted_Trees", {"trees": trees, "depth": how.depth, "rate": how.rate}, {"MAPE": m.mape, "RMSE": m.rmse}, {"nodes": nodes})
    run = registry.save(forecasting.sarima_likelihood(parts), coefficients)
    m = forecasting.metrics(forecasting.sarima_by_models(parts, registry.model(spark, coefficients, run))).first()
    registry.log(spark, runs, run, "SARIMA_Baseline", {"order": "(1, 1, 1)(1, 1, 0, 4)"}, {"MAPE": m.mape, "RMSE": m.rmse}, {"coefficients": coefficients})
    latest = written(registry.latest(spark, runs), "latest-runs")
    for name in (runs, nodes, coefficients):
        spark.sql(f"DROP TABLE {name}")
    return latest.select("run_name", "kind", "key", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_transactions": clean_transactions,
    "monthly_revenue": monthly_revenue,
    "top10_products": top10_products,
    "top100_skus": top100_skus,
    "weekly_demand": weekly_demand,
    "dense_weekly_demand": dense_weekly_demand,
    "weekly_features": _features,
    "top_sku": top_sku,
    "sku_history_latest4": sku_history_latest4,
    "forecast_horizon": forecast_horizon,
    "forecast_responses": forecast_responses,
    "rfm": _rfm,
    "rfm_events": rfm_events,
    "weekly_events": weekly_events,
    "rfm_scaled": rfm_scaled,
    "assign_fixed_centroids": assign_fixed_centroids,
    "label_clusters": label_clusters,
    "customer_segments": _segments,
    "segment_summary": segment_summary,
    "segment_lookup": segment_lookup,
    "segment_actions": segment_actions,
    "net_quantities": net_quantities,
    "train_test_split": train_test_split,
    "naive_metrics": naive_metrics,
    "k_means_segments": k_means_segments,
    "gbt_forecast": gbt_forecast,
    "boosted_first_tree": boosted_first_tree,
    "sarima_forecast": sarima_forecast,
    "yearly_forecast": yearly_forecast,
    "trend_forecast": trend_forecast,
    "trend_design": trend_design,
    "model_comparison": model_comparison,
    "row_counts": row_counts,
    "projected_transactions": projected_transactions,
    "inline_rows": inline_rows,
    "known_products": known_products,
    "ordered_features": ordered_features,
    "features_preview": features_preview,
    "stored_tables": stored_tables,
    "k_means_fixed_start": k_means_fixed_start,
    "sarima_fixed": sarima_fixed,
    "sarima_likelihood": sarima_likelihood,
    "yearly_normal_equations": yearly_normal_equations,
    "saved_model_runs": saved_model_runs,
    "keyed_transactions": keyed_transactions,
    "stored_answers": stored_answers,
    "repeated_append": repeated_append,
}
