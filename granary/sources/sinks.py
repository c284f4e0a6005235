"""Writing tables, and a table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.schemas import RUNS
from granary.tables import dropped, written


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a managed table by ``df``."""
    df.write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Append to a managed table. Appending the same sales twice doubles amounts, so
    pipelines replace by default."""
    df.write.mode("append").saveAsTable(name)


def store_by_key(df: DataFrame, name: str, key: str, buckets: int = 32) -> None:
    """Replace a managed table by ``df``, in buckets by ``key`` and sorted there: a query for one key
    reads one bucket, and of its files the row groups that may hold the key."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def digest(df: DataFrame) -> str:
    """A batch's number of rows and the sum of its rows' hashes: the same in any order and any partitions."""
    columns = [*(F.col(f"`{c}`").cast("string") for c in df.columns), *(F.col(f"`{c}`").isNull() for c in df.columns)]
    row, other = (F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in (0, 1))
    r = df.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(other).alias("b")).first()
    return f"{r.n}:{r.a or 0}:{r.b or 0}"


def append_once(df: DataFrame, name: str) -> bool:
    """Append a batch unless it was appended before; whether it was.

    Batches are partitions of the table, named by their digest. The batch's partition is
    written first and whole, replacing what a broken run left of it, and then entered in the
    ledger, the table ``name``_ledger. :func:`appended` reads batches of the ledger only, so
    half a batch is never seen, and a repeated run finds the batch or writes it again.
    The batch is computed once: it is written aside, and the digest and the partition come from there.
    """
    rows = written(df, "batch")
    try:
        return _enter(rows, name)
    finally:
        dropped(rows)


def _enter(df: DataFrame, name: str) -> bool:
    spark, key, ledger = df.sparkSession, digest(df), f"{name}_ledger"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {ledger} (batch string) USING parquet")
    if not spark.table(ledger).where(F.col("batch") == F.lit(key)).isEmpty():
        return False
    create = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({create}, batch string) USING parquet PARTITIONED BY (batch)")
    columns = [c for c in spark.table(name).columns if c != "batch"]
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = '{key}') SELECT * FROM {{rows}}", rows=df.select(*columns))
    append_table(spark.createDataFrame([(key,)], "batch string"), ledger)
    return True


def appended(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows of batches that were appended whole."""
    return spark.table(name).join(spark.table(f"{name}_ledger"), "batch", "left_semi").drop("batch")


def drop_appended(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_ledger"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_database(df: DataFrame, options: dict[str, str], name: str, mode: str = "overwrite") -> None:
    df.write.format("jdbc").options(**options).option("dbtable", name).mode(mode).save()


def create_if_missing(spark: SparkSession, name: str, schema: StructType) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def run_rows(spark: SparkSession, run: str, params: dict[str, object], metrics: dict[str, float], artifacts: dict[str, str] | None = None) -> DataFrame:
    """A run's parameters, metrics and places of saved models, one row each."""
    rows = [(run, "param", k, str(v)) for k, v in params.items()] + [(run, "metric", k, repr(float(v))) for k, v in metrics.items()]
    return spark.createDataFrame(rows + [(run, "artifact", k, v) for k, v in (artifacts or {}).items()], RUNS)


def log_run(spark: SparkSession, table: str, run: str, params: dict[str, object], metrics: dict[str, float], artifacts: dict[str, str] | None = None) -> None:
    """Append a run to a table of runs."""
    append_table(run_rows(spark, run, params, metrics, artifacts), table)


def save_model(model, path: str) -> str:
    """Write a fitted Spark ML model, replacing an earlier one; the path can be logged as an artifact."""
    model.write().overwrite().save(path)
    return path
