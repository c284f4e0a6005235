"""Hand-made rows for each rule that the generated tables do not show."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from granary import serving
from granary.operators import cleaning, customers, demand, forecasting, revenue
from granary.schemas import CUSTOMER_SEGMENTS, RAW_SALES, TRANSACTIONS, WEEKLY_FEATURES
from granary.session import jdbc_options
from granary.sources import sales, sinks
from granary.streaming import weekly


def at(text):
    return datetime.datetime.fromisoformat(text)


def sale(stock="a", quantity=1, date="2024-01-07T10:00:00", invoice="1", price=1.0, customer=1.0, description="d"):
    return (invoice, stock, description, quantity, at(date) if date else None, price, customer, "X")


def transactions(spark, rows):
    return spark.createDataFrame(rows, TRANSACTIONS)


def test_clean(spark):
    rows = [
        *(sale(invoice=i) for i in ("536365", "C536379", "c1", None, "A1")), sale(customer=None), sale(customer=float("nan")),
        *(sale(quantity=q) for q in (0, -1, None)), *(sale(price=p) for p in (0.0, -2.0, None)),
    ]
    seen = Observation()
    out = cleaning.clean(sales.sales_rows(spark, rows), seen)
    assert [f.name for f in out.schema] == TRANSACTIONS.names
    assert {r.invoice_no for r in out.collect()} == {"536365", "c1", None, "A1"}
    assert seen.get["rows"] == 4
    with pytest.raises(ValueError, match="Price"):
        cleaning.clean(sales.sales_rows(spark, rows).drop("Price"))


def test_extras(spark):
    raw = sales.sales_rows(spark, [sale(quantity=5), sale(quantity=5), sale(quantity=-2, invoice="C1"), sale(stock="b", quantity=3)])
    assert {r.stock_code: r.net_quantity for r in cleaning.net_of_cancellations(raw).collect()} == {"a": 8, "b": 3}
    assert cleaning.deduplicated(cleaning.clean(raw)).count() == 2


def test_monthly_revenue_has_all_months(spark):
    df = transactions(spark, [sale(date="2024-01-31T12:00:00", price=1.5), sale(date="2024-04-01T00:00:00", price=2.0), sale(date=None)])
    got = {str(r.month_end): r.revenue for r in revenue.monthly_revenue(df).collect()}
    assert got == {"2024-01-31": 1.5, "2024-02-29": 0.0, "2024-03-31": 0.0, "2024-04-30": 2.0}
    assert revenue.monthly_revenue(df.limit(0)).count() == 0


def test_top_products_and_ties(spark):
    df = transactions(spark, [sale(s, q, description=d) for s, q, d in [("d", 7, "x"), ("c", 7, "w"), ("b", 7, None), ("e", 9, "w"), (None, 99, "v")]])
    assert [r.stock_code for r in revenue.top_skus(df, 2).collect()] == ["e", "b"]
    assert [r.description for r in revenue.top_products(df, 2).collect()] == ["v", "w"]
    features = spark.createDataFrame([(at("2024-01-07"), s, q) for s, q in [("c", 7), ("b", 7), ("a", 1)]], "week timestamp_ntz, stock_code string, weekly_sales bigint")
    assert demand.top_sku(features).first().stock_code == "b"


def test_weeks_end_on_sunday(spark):
    rows = [("a", "2024-01-07T10:00:00", 1), ("a", "2024-01-07T00:00:00", 6), ("a", "2024-01-08T00:00:00", 2), ("b", "2024-01-14T23:59:59.5", 4), ("a", "2024-01-29T05:00:00", 3), (None, "2024-01-07T00:00:00", 5)]
    df = transactions(spark, [sale(s, q, d) for s, d, q in rows])
    got = {(str(r.week.date()), r.stock_code): r.weekly_sales for r in demand.weekly_demand(df).collect()}
    assert got == {("2024-01-07", "a"): 7, ("2024-01-14", "a"): 2, ("2024-01-14", "b"): 4, ("2024-02-04", "a"): 3}
    dense = demand.with_empty_weeks(demand.weekly_demand(df))
    assert [r.weekly_sales for r in dense.where("stock_code = 'a'").orderBy("week").collect()] == [7, 2, 0, 0, 3]


def weeks(spark, series):
    rows = [(at("2024-01-07") + datetime.timedelta(days=7 * i), s, q) for s, values in series.items() for i, q in enumerate(values)]
    return spark.createDataFrame(rows, "week timestamp_ntz, stock_code string, weekly_sales bigint")


def test_features(spark):
    df = demand.features(weeks(spark, {"a": [1, 2, 3, 4, 5, 6], "b": [9], "c": [5, 6], "d": [1, 2, 3]}))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in WEEKLY_FEATURES]
    rows = df.orderBy("stock_code", "week").collect()
    assert [(r.stock_code, r.weekly_sales, r.rolling_4_wk_avg) for r in rows] == [("a", 3, 1.5), ("a", 4, 2.0), ("a", 5, 2.5), ("a", 6, 3.5), ("d", 3, 1.5)]
    assert rows[0].month == 1 and rows[3].month == 2


def test_recency_is_elapsed_days(spark):
    df = transactions(spark, [sale(customer=float(i), date=d, invoice=f"{i}{k}") for k in (0, 1) for i, d in enumerate(["2024-01-10T08:00:00", "2024-01-09T09:00:00", "2024-01-09T08:00:00", "2024-01-09T07:00:00"])])
    got = {r.customer_id: (r.recency, r.frequency, r.monetary) for r in customers.rfm(df).collect()}
    assert got == {0.0: (1, 2, 2.0), 1.0: (1, 2, 2.0), 2.0: (2, 2, 2.0), 3.0: (2, 2, 2.0)}
    assert all(r.z_monetary == 0 for r in customers.scaled(customers.rfm(df)).collect())


def test_labels_follow_mean_monetary(spark):
    rows = [(float(i), 1, 1, m, c) for i, (c, m) in enumerate([(0, 500.0), (1, 20.0), (2, 9000.0), (3, 100.0)])]
    df = spark.createDataFrame(rows, "customer_id double, recency bigint, frequency bigint, monetary double, cluster int")
    out = customers.labelled(df, check=True)
    assert {r.cluster: r.segment_label for r in out.collect()} == {1: "Hibernating / At-Risk", 3: "About to Sleep", 0: "Leal Customers", 2: "Champions"}
    assert out.columns == CUSTOMER_SEGMENTS.names
    with pytest.raises(ValueError):
        customers.labelled(df.where("cluster < 3"), check=True)
    summary = {r.segment_label: (r.monetary, r.customer_count) for r in customers.segment_summary(out).collect()}
    assert summary["Champions"] == (9000.0, 1)


def test_k_means_takes_the_best_start(spark):
    rng = np.random.default_rng(1)
    rows = [(float(i), *map(float, rng.normal(c, 0.1, 3))) for i, c in enumerate(np.repeat([0, 3, 6, 9], 30))]
    df = spark.createDataFrame(rows, "customer_id double, z_recency double, z_frequency double, z_monetary double")
    out, cost = customers.k_means(df, starts=3)
    assert cost <= customers.k_means(df, starts=1)[1] + 1e-9 and cost < 10
    assert customers.silhouette(out) > 0.9


def test_forecast(spark):
    df = weeks(spark, {"a": [99, 8, 12, 10, 10], "b": [3]})
    assert serving.forecast(df, "a", 3) == {"stock_code": "a", "forecast_horizon_weeks": 3, "predictions": [{"week_horizon": h, "predicted_quantity": q} for h, q in [(1, 10.2), (2, 10.4), (3, 10.6)]]}
    assert serving.forecast(df, "b", 0)["predictions"] == [] and serving.forecast(df, "b", -1)["predictions"] == []
    assert forecasting.horizon_forecast(df, 0).count() == 0
    with pytest.raises(serving.NotFound):
        serving.forecast(df, "a' OR '1'='1")
    with pytest.raises(TypeError):
        serving.forecast(df, 5)
    assert {r.stock_code: len(r.predictions) for r in serving.forecasts(df, 6).collect()} == {"a": 6, "b": 6}


def test_roundings(spark):
    from granary.functions.numeric import round_exact, round_scaled

    values = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (0.375,)], "x double")
    assert [r[0] for r in values.select(round_scaled(F.col("x"))).collect()] == [2.68, 0.12, 1.0, 0.38]
    rng = np.random.default_rng(1)
    many = [2.675, 0.125, 1.005, 0.375, -2.675, -0.125, 0.0, 1e17, 123456789.125, 4.015, 1.115, *map(float, rng.integers(0, 10**7, 3000) / 1000), *map(float, rng.normal(0, 1e6, 2000))]
    got = spark.createDataFrame([(x,) for x in many] + [(None,)], "x double").select("x", round_exact(F.col("x")).alias("r")).collect()
    assert all(r.r == (None if r.x is None else round(r.x, 2)) for r in got)


def test_segment(spark):
    df = spark.createDataFrame([(17841.0, 3, 12, 2.675, 2, "Champions"), (1.0, 1, 1, 0.125, 0, "?")], CUSTOMER_SEGMENTS)
    got = serving.segment(df, 17841)
    assert got["metrics"] == {"days_since_last_purchase": 3, "total_lifetime_orders": 12, "total_monetary_spend": 2.67}
    assert got["segmentation"]["strategic_next_action"].startswith("Offer early access")
    assert serving.segment(df, 1)["segmentation"]["strategic_next_action"] == customers.OTHER_ACTION
    assert {r.metrics.total_monetary_spend for r in serving.segments(df).collect()} == {2.67, 0.12}
    with pytest.raises(serving.NotFound):
        serving.segment(df, 2)
    assert serving.health()["status"] == "healthy"


def test_split_and_metrics(spark):
    parts = forecasting.split(weeks(spark, {"a": range(1, 6), "b": [1, 2, 3], "c": [4]}))
    got = {s: [r.part for r in parts.where(F.col("stock_code") == s).orderBy("week").collect()] for s in "abc"}
    assert got == {"a": ["train"] * 4 + ["test"], "b": ["train"] * 2 + ["test"], "c": ["test"]}
    rows = spark.createDataFrame([(10, 8.0), (20, 25.0)], "weekly_sales bigint, prediction double")
    m = forecasting.metrics(rows).first()
    assert m.mape == pytest.approx(0.225) and m.rmse == pytest.approx(np.sqrt(14.5))


def test_sarima_continues_a_seasonal_trend():
    y = np.array([10 + 2 * t + [5, -3, 1, -3][t % 4] for t in range(40)], float)
    assert np.abs(forecasting.sarima(y[:32], 8) - y[32:]).max() < 1e-6
    assert forecasting.sarima(np.array([3.0, 4.0]), 2).tolist() == [4.0, 4.0] and forecasting.sarima(np.array([]), 1).tolist() == [0.0]


def test_sarima_grid_finds_the_least_of_plain_recursions():
    """Residuals of all coefficients at once equal the recursion written out, one at a time."""
    rng = np.random.default_rng(3)
    w = rng.normal(size=23)
    grid = rng.uniform(-0.9, 0.9, (40, 3))
    got = forecasting._sarima_residuals(w, *grid.T)
    for (phi, seasonal, theta), row in zip(grid, got, strict=True):
        e: list[float] = []
        at = lambda t: w[t] if t >= 0 else 0.0
        for t in range(len(w)):
            e.append(at(t) - phi * at(t - 1) - seasonal * at(t - 4) + phi * seasonal * at(t - 5) - (theta * e[-1] if e else 0.0))
        assert np.allclose(row, e)


def test_yearly_weights_solve_ridge_regression(spark):
    """Weights from sums of products equal the plain solution on the rows."""
    y = [50 + i + 10 * np.sin(2 * np.pi * i / 52) for i in range(80)]
    parts = forecasting.split(weeks(spark, {"a": map(int, y), "b": range(7)}))
    termed = forecasting.yearly_terms(parts)
    weights = {r.stock_code: r.weights for r in forecasting.yearly_weights(forecasting.normal_equations(termed)).collect()}
    for code in "ab":
        rows = [r for r in termed.where(F.col("stock_code") == code).collect() if r.part == "train"]
        x = np.array([r.terms for r in rows])
        keep = np.diag([1e-6, 1e-6, *[1.0] * 6])
        assert np.allclose(x @ weights[code], x @ np.linalg.solve(x.T @ x + keep, x.T @ np.array([float(r.weekly_sales) for r in rows])), atol=1e-4)
    assert forecasting.yearly_forecast(parts).count() == 16 + 2


def test_lloyd_lowers_the_cost_and_keeps_empty_centers(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(float(i), *map(float, rng.normal(c, 0.3, 3))) for i, c in enumerate(np.repeat([0, 2, 5], 30))], "customer_id double, z_recency double, z_frequency double, z_monetary double")
    start = [(0.5, 0.5, 0.5), (2.5, 2.5, 2.5), (4.0, 4.0, 4.0), (99.0, 99.0, 99.0)]
    costs = []
    for steps in (0, 1, 3):
        centers, clustered = customers.lloyd(points, start, steps)
        costs.append(sum(r.cost for r in customers.cost(clustered, centers).collect()))
    assert costs[0] > costs[1] >= costs[2] and centers[3] == (99.0, 99.0, 99.0)


def test_last_event_of_all_counts_without_a_customer(spark):
    rows = [(1.0, "a", at("2024-01-01"), 1.0), (1.0, "b", at("2024-01-03"), 2.0), (None, "c", at("2024-01-09"), 9.0)]
    events = spark.createDataFrame(rows, "who double, order string, ts timestamp_ntz, value double")
    assert [tuple(r) for r in customers.profiles(events, "who", "order", "ts", F.col("value")).collect()] == [(1.0, 7, 2, 3.0)]


def test_undated_sales_count_for_the_rank_only(spark):
    df = transactions(spark, [sale("a", 5), sale("a", 9, date=None), sale("b", 8), sale("c", 7, date=None)])
    assert [(r.stock_code, r.weekly_sales) for r in demand.weekly_demand(df, 1).collect()] == [("a", 5)]


def test_known_products(spark):
    codes = spark.createDataFrame([("a",), ("zz",), (None,)], "stock_code string")
    assert {r.stock_code: r.found for r in serving.known(weeks(spark, {"a": [1]}), codes).collect()} == {"a": True, "zz": False, None: False}


def test_saved_model_predicts_as_before(spark, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel

    parts = forecasting.split(demand.features(weeks(spark, {"a": [3, 9, 4, 8, 5, 7, 6, 9, 4, 8, 3, 9]})))
    model = forecasting.fit_boosted_trees(parts)
    path = sinks.save_model(model, f"{tmp_path}/trees")
    predicted = lambda m: sorted((r.week, r.prediction) for r in forecasting.tree_predictions(m, parts).collect())
    assert predicted(GBTRegressionModel.load(sinks.save_model(model, path))) == predicted(model)
    assert ("r", "artifact", "model", path) in {tuple(r) for r in sinks.run_rows(spark, "r", {}, {}, {"model": path}).collect()}


def test_shared_folder(spark):
    from types import SimpleNamespace

    from granary.session import shared_dir

    def named(master, root=None):
        return SimpleNamespace(conf={"spark.checkpoint.dir": root} if root else {}, sparkContext=SimpleNamespace(master=master, applicationId="x"))

    assert shared_dir(named("spark://h:1", "hdfs:///c/")) == "hdfs:///c/granary-x"
    assert shared_dir(named("local[8]")).endswith("/granary-x")
    for master in ("spark://h:1", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_dir(named(master))


def test_files_tables_and_runs(spark, tmp_path):
    raw = sales.sales_rows(spark, [sale(), sale(stock="b", customer=None)])
    raw.write.option("header", True).csv(f"{tmp_path}/csv")
    raw.write.parquet(f"{tmp_path}/parquet")
    assert sales.sales_csv(spark, f"{tmp_path}/csv").schema == RAW_SALES
    assert sales.sales_csv(spark, f"{tmp_path}/csv").exceptAll(sales.sales_parquet(spark, f"{tmp_path}/parquet")).isEmpty()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    try:
        sinks.create_if_missing(spark, "shop.transactions", TRANSACTIONS)
        assert sales.stored(spark, "shop.transactions").schema == TRANSACTIONS
        clean = cleaning.clean(raw)
        sinks.append_table(clean, "shop.transactions")
        sinks.append_table(clean, "shop.transactions")
        assert sales.stored(spark, "shop.transactions", ["stock_code"]).count() == 2
        sinks.replace_table(clean, "shop.copy")
        sinks.replace_table(clean, "shop.copy")
        assert spark.table("shop.copy").count() == 1
        sinks.log_run(spark, "shop.runs", "r", {"order": "(1,1,1)"}, {"MAPE": 0.5})
        assert {(r.kind, r.key, r.value) for r in spark.table("shop.runs").collect()} == {("param", "order", "(1,1,1)"), ("metric", "MAPE", "0.5")}
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_connection_settings():
    assert jdbc_options({"DATABASE_URL": "postgresql://u:p@h:5432/d"}) == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}
    assert jdbc_options({"POSTGRES_USER": "u", "POSTGRES_PASSWORD": "p", "POSTGRES_DB": "d"})["url"].endswith("/d")
    with pytest.raises(ValueError):
        jdbc_options({})


def test_weekly_stream(spark, tmp_path):
    rows = [("a", "2024-01-07T10:00:00", 1), ("a", "2024-01-08T00:00:00", 2), ("a", "2024-01-14T23:59:59", 4)]
    df = transactions(spark, [sale(s, q, d) for s, d, q in rows]).withColumn("invoice_date", F.col("invoice_date").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = weekly.weekly_demand(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("weekly").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert {str(r.week.date()): r.weekly_sales for r in spark.table("weekly").collect()} == {"2024-01-07": 1, "2024-01-14": 6}
