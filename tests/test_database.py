"""Parallel reads of a database by keys that are no numbers, against the bundled Derby."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from granary.sources import sales


@pytest.fixture
def derby(spark):
    options = {"url": f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(4000, numPartitions=2).select(
        F.when(F.col("id") % 100 != 0, F.concat(F.when(F.col("id") < 3000, "a'").otherwise("zz"), F.lpad((F.col("id") * 7919 % 4001).cast("string"), 5, "0"))).otherwise("none").alias("code"),
        F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id % 50 as int))").cast("timestamp").alias("bought"), F.col("id").cast("int").alias("n"),
    )
    rows.write.format("jdbc").options(**options).option("dbtable", "sold").option("createTableColumnTypes", "code VARCHAR(20)").save()
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"])
    connection.createStatement().execute("UPDATE sold SET \"code\" = NULL WHERE \"code\" = 'none'")
    connection.close()
    return options


@pytest.mark.parametrize("key,most", [('"code"', 2.0), ('"bought"', 2.0), ('"n"', 2.0)])
def test_ranges_are_alike_in_size(spark, derby, key, most):
    got = sales.database_table_by(spark, derby, "sold", key, 8)
    assert got.rdd.getNumPartitions() == 8
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < most * 4000 / 8
    assert got.select("n").distinct().count() == 4000


def test_few_keys(spark, derby):
    """One key for all rows, and an empty table, are one range."""
    assert sales.key_ranges(spark.range(0), 4) == []
    assert sales.range_conditions("k", []) == ["1 = 1"]
    one = spark.range(50).select(F.lit("x'y").alias("k"))
    assert sales.range_conditions("k", sales.key_ranges(one, 4)) == ["k < 'x''y' OR k IS NULL", "k >= 'x''y'"]
    assert sales.range_conditions("k", [datetime.datetime(2020, 1, 2)])[1] == "k >= TIMESTAMP('2020-01-02 00:00:00.000000')"
