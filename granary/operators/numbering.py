"""Positions of rows in an order over a whole table, and neighbours in it.

Rows are dealt to range partitions of the order and sorted there, so no task sees more
than its share; a row's place in its partition and the sizes of the partitions before it
make its position. Equal rows of the order are told apart by the place that they come
from, so a key that holds a large part of all rows is spread over partitions too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.tables import written

#: Bits of monotonically_increasing_id that count inside a partition.
INSIDE = 33


def placed(rows: DataFrame, order: list[Column | str], at: str) -> DataFrame:
    """``rows`` in range partitions of ``order``, written; adds ``at``: the partition, and below ``INSIDE`` bits the place in it."""
    tie = f"{at}_tie"
    keys = [*order, tie]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return written(dealt.withColumn(at, F.monotonically_increasing_id()), "placed")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Adds ``name``: 1, 2, 3... in ``order``, without gaps. Among equals of ``order`` any
    succession is right, and one is kept.

    The partitioned rows are written once, as their places and the partitions' sizes are
    both read from them. Only one row for each partition is broadcast, and numbered in one task.
    """
    at, part, start = f"{name}_at", f"{name}_part", f"{name}_start"
    table = placed(rows, order, at)
    number, inside = F.shiftright(at, INSIDE), F.col(at).bitwiseAND((1 << INSIDE) - 1)
    sizes = table.groupBy(number.alias(part)).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, before.alias(start))
    return table.join(F.broadcast(starts), number == F.col(part)).select(*rows.columns, (F.col(start) + inside + 1).alias(name))


def below(ids: DataFrame, key: str) -> DataFrame:
    """(``key``, below): for each distinct non-null long ``key`` the next smaller one, null for the least.

    Positions are dense whatever the keys are, so each meets the one before it in a join that is dealt evenly.
    """
    keys = written(numbered(ids.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct(), ["k"], "p"), "keys")
    before = keys.select(F.col("k").alias("below"), (F.col("p") + 1).alias("p"))
    return keys.join(before, "p", "left").select(F.col("k").alias(key), "below")
