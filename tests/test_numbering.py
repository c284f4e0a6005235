"""Global positions and neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators.numbering import INSIDE, below, numbered, placed


def test_positions_follow_the_order(spark):
    random.seed(3)
    rows = [(random.choice([None, -5, 0, 7, 7, 7, random.randint(-99, 99)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = numbered(df, [F.col("a").desc_nulls_last(), "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(r.position for r in got) == list(range(1, 3001))
    assert numbered(df.limit(0), ["a"]).collect() == []


def test_equal_rows_are_spread(spark):
    """A key with nearly all rows does not go to one partition."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000, numPartitions=6).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"))
        sizes = [r["count"] for r in placed(df, ["k"], "at").groupBy(F.shiftright("at", INSIDE)).count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 2 * 20_000 / 8
        ordered = [r.k for r in numbered(df, ["k"]).orderBy("position").collect()]
        assert ordered == sorted(ordered)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["dense", "hashed", "negative"])
def test_below(spark, kind):
    keys = spark.range(5000)
    keys = {"dense": keys.select("id"), "hashed": keys.select(F.xxhash64("id").alias("id")), "negative": keys.select((-F.col("id") * 3).alias("id"))}[kind]
    keys = keys.union(keys.limit(50)).union(spark.sql("select cast(null as bigint)"))
    want = sorted({r.id for r in keys.where("id is not null").collect()})
    got = {r.id: r.below for r in below(keys, "id").collect()}
    assert got == dict(zip(want, [None, *want], strict=False))
