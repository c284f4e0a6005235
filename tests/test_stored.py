"""Appends that can be repeated, the registry, lookups by key."""

import uuid

import pytest
from pyspark.sql import functions as F

from granary import serving
from granary.operators import boosting, forecasting, statespace
from granary.plans import queries
from granary.sources import registry, sinks
from granary.sources.sales import star_sales
from tests.duck import TESTDATA


@pytest.fixture
def name(spark):
    n = f"t_{uuid.uuid4().hex}"
    yield n
    for table in (n, f"{n}_ledger"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_a_batch_is_appended_once(spark, name):
    """In any order and partitions, with nulls; equal rows in a batch stay; another batch with the same rows in part is new."""
    rows = [(1, "a"), (1, "a"), (None, None), (2, "")]
    batch = spark.createDataFrame(rows, "x int, y string")
    assert sinks.append_once(batch, name) and not sinks.append_once(batch.orderBy(F.desc("x")).repartition(3), name)
    assert sinks.append_once(batch.limit(3).union(batch.where("x = 2")).union(batch.where("x = 2")), name)
    assert sinks.appended(spark, name).count() == 9
    assert sinks.digest(batch) != sinks.digest(spark.createDataFrame([(1, "a"), (1, "a"), (None, ""), (2, None)], batch.schema))


def test_a_broken_run_is_completed(spark, name):
    """What was written before the ledger's entry is not seen, and is replaced by the next run."""
    batch = spark.range(10).toDF("x")
    assert sinks.append_once(batch, name)
    more = spark.range(5).toDF("x")
    spark.sql(f"INSERT INTO {name} PARTITION (batch = '{sinks.digest(more)}') VALUES (99)")
    assert sinks.appended(spark, name).count() == 10
    assert sinks.append_once(more, name)
    assert sorted(r.x for r in sinks.appended(spark, name).collect()) == sorted([*range(10), *range(5)])


def test_a_lookup_reads_one_bucket(spark, name):
    rows = spark.range(4000).select(F.col("id").cast("double").alias("customer_id"), F.lit(3).cast("long").alias("recency"), F.lit(2).cast("long").alias("frequency"), (F.col("id") * 1.005).alias("monetary"), F.lit(0).alias("cluster"), F.lit("Champions").alias("segment_label"))
    sinks.store_by_key(rows, name, "customer_id", 16)
    asked = spark.table(name).where(F.col("customer_id") == 7.0)
    assert len(asked.collect()) == 1
    scan = asked._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numOutputRows").value() < 500  # of 4000: one bucket's rows
    assert serving.segment(spark.table(name), 7.0)["metrics"]["days_since_last_purchase"] == 3
    with pytest.raises(serving.NotFound):
        serving.segment(spark.table(name), 99999.0)


def test_registry(spark, name):
    models, runs = f"{name}_m", f"{name}_r"
    try:
        days = spark.range(30).select(F.lit("a").alias("stock_code"), F.expr("timestamp_ntz'2024-01-07' + make_interval(0, 0, cast(id as int))").alias("week"), (F.col("id") % 4 * 5 + F.col("id")).alias("weekly_sales"), F.col("id").cast("double").alias("lag_1_week"), (F.col("id") % 4).cast("double").alias("lag_2_week"), F.lit(1.0).alias("rolling_4_wk_avg"), F.lit(1).alias("month"))
        parts = forecasting.split(days)
        test = parts.where("part = 'test'")
        ids = []
        for trees in (1, 30):
            run = registry.save(boosting.fit_products(parts, boosting.Boosting(trees=trees)), models)
            rmse = forecasting.metrics(boosting.predict_products(registry.model(spark, models, run), test)).first().rmse
            registry.log(spark, runs, run, "trees", {"n": trees}, {"RMSE": rmse}, {"nodes": models})
            ids.append(run)
        want = sorted(boosting.predict_products(boosting.fit_products(parts, boosting.Boosting(trees=1)), test).collect())
        assert sorted(boosting.predict_products(registry.model(spark, models, ids[0]), test).collect()) == want
        assert {(r.run_id, r.value) for r in registry.latest(spark, runs).where("kind = 'param'").collect()} == {(ids[1], "30")}
        assert registry.best(spark, runs, "RMSE").first().run_id == ids[1]
        fitted = forecasting.sarima_likelihood(parts)
        y = [float(r.weekly_sales) for r in parts.where("part = 'train'").orderBy("week").collect()]
        got = [r.prediction for r in forecasting.sarima_by_models(parts, fitted).orderBy("week").collect()]
        assert got == pytest.approx(list(statespace.forecast(y, len(got))))
    finally:
        for t in (models, runs):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


@pytest.fixture
def computed(spark, monkeypatch):
    """Counts the raw sales that a query computes, however often it computes them."""
    rows = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    def sales(*args):
        df = star_sales(*args)
        return df.mapInArrow(counting, df.schema)

    monkeypatch.setattr(queries, "star_sales", sales)
    return rows


def lines(spark):
    return spark.read.parquet(f"{TESTDATA}/lineitem.parquet").count()


def test_batches_are_drawn_from_sales_computed_once(spark, computed):
    queries.repeated_append(spark, TESTDATA).collect()
    assert computed.value == lines(spark)


def test_tables_are_stored_from_sales_computed_once(spark, computed):
    queries.stored_tables(spark, TESTDATA).collect()
    assert computed.value == lines(spark)


def test_a_batch_is_computed_once(spark, name):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    batch = spark.range(40).toDF("x").mapInArrow(counting, "x long")
    assert sinks.append_once(batch, name) and seen.value == 40
    assert sorted(r.x for r in sinks.appended(spark, name).collect()) == list(range(40))


def test_only_orders_are_dealt_by_customer(spark):
    """Without broadcasts: lines, four times as many, are not shuffled to meet the customers."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star_sales(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(plan) if "hashpartitioning(o_custkey" in x)
    end = next((i for i in range(at + 1, len(plan)) if depth(plan[i]) <= depth(plan[at])), len(plan))
    below = plan[at:end]
    assert any("o_orderdate" in x for x in below) and not any("l_orderkey" in x for x in below)
