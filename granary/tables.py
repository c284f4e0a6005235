"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Cuts lineage so that a lost executor never costs more than the last table,
    and an expensive scan (tokenising, hashing) is made once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.granary_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that :func:`written` made, when no later step reads it."""
    if path := getattr(df, "granary_path", None):
        _delete(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Delete what results of this application still read, once they are read."""
    _delete(spark, shared_dir(spark))
