"""Shared helpers: tables of a folder, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from granary.operators.numbering import below
from granary.session import shared_dir
from granary.tables import dropped, released, written

__all__ = ["arrow_map", "below", "dropped", "released", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a worker that ``make`` builds once per task.

    The worker gets record batches and yields dicts of columns; arrays are given
    the declared types, so an empty batch keeps its schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
