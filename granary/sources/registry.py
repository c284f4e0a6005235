"""Runs and models as tables: a run is rows of parameters, metrics and artifacts, a model is rows under a run's id."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.sinks import append_table

RUNS = "run_id string, at timestamp_ntz, run_name string, kind string, key string, value string"


def save(model: DataFrame, table: str) -> str:
    """Append a model's rows to a table of models, under a new id that is returned. Models never overwrite each other."""
    run = uuid.uuid4().hex
    append_table(model.withColumn("run_id", F.lit(run)), table)
    return run


def model(spark: SparkSession, table: str, run: str) -> DataFrame:
    """The rows of one model."""
    return spark.table(table).where(F.col("run_id") == F.lit(run)).drop("run_id")


def log(spark: SparkSession, table: str, run: str, name: str, params: dict[str, object], metrics: dict[str, float], artifacts: dict[str, str]) -> None:
    """Append a run; earlier ones stay."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [(run, now, name, kind, k, repr(float(v)) if kind == "metric" else str(v)) for kind, found in (("param", params), ("metric", metrics), ("artifact", artifacts)) for k, v in found.items()]
    append_table(spark.createDataFrame(rows, RUNS), table)


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the latest run of every name."""
    rank = F.dense_rank().over(Window.partitionBy("run_name").orderBy(F.desc("at"), F.desc("run_id")))
    return spark.table(table).withColumn("nth", rank).where("nth = 1").drop("nth")


def best(spark: SparkSession, table: str, metric: str) -> DataFrame:
    """(run_name, run_id, value): of every name the run with the least value of a metric, the earliest of equals."""
    rows = spark.table(table).where((F.col("kind") == "metric") & (F.col("key") == metric)).withColumn("value", F.col("value").cast("double"))
    rank = F.row_number().over(Window.partitionBy("run_name").orderBy(F.asc_nulls_last("value"), "at", "run_id"))
    return rows.withColumn("nth", rank).where("nth = 1").select("run_name", "run_id", "value")
