"""Raw sales from files, databases, or a star schema of orders."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.schemas import RAW_SALES
from granary.sources.workbook import sheets


def sales_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Sales sheets as CSV with a header, read with a fixed schema."""
    return spark.read.schema(RAW_SALES).options(header=True, **options).csv(path)


def sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SALES).parquet(path)


def sales_workbook(spark: SparkSession, path: str, sheet: str = "Year 2010-2011") -> DataFrame:
    """One sheet of a workbook, or of every workbook that ``path`` matches."""
    return sheets(spark, path, sheet, RAW_SALES)


def sales_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RAW_SALES)


def stored(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table, whole or only some columns (pruned at the scan)."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def stored_in_order(spark: SparkSession, name: str, *by: str) -> DataFrame:
    """A stored table in the order of some columns."""
    return spark.table(name).orderBy(*by)


def database_table(spark: SparkSession, options: dict[str, str], name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> DataFrame:
    """A table by JDBC; with a numeric ``key``, in ``parts`` parallel ranges."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def key_ranges(keys: DataFrame, parts: int, sample: int = 100) -> list:
    """Up to ``parts`` - 1 bounds between ranges of keys that hold about as many rows each, whatever the keys' type.

    They are quantiles of a random sample of some ``sample`` rows a range, the only rows that reach the driver.
    """
    key = keys.columns[0]
    some = keys.where(F.col(key).isNotNull())
    n = some.count()
    drawn = some.sample(min(1.0, parts * sample / max(1, n)), seed=1) if n > parts * sample else some
    found = [r[0] for r in drawn.sort(key).collect()]
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def range_conditions(key: str, bounds: list) -> list[str]:
    """SQL conditions of the ranges between bounds; together they hold each row once, those without a key in the first."""
    def text(v) -> str:
        if isinstance(v, datetime):
            return f"TIMESTAMP('{v.isoformat(sep=' ', timespec='microseconds')}')"
        return str(v) if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    marks = list(map(text, bounds))
    if not marks:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(marks, marks[1:], strict=False)]
    return [f"{key} < {marks[0]} OR {key} IS NULL", *inner, f"{key} >= {marks[-1]}"]


def database_table_by(spark: SparkSession, options: dict[str, str], name: str, key: str, parts: int) -> DataFrame:
    """A table by JDBC in ``parts`` parallel ranges of a key of any ordered type (text, times, numbers), alike in size."""
    keys = spark.read.format("jdbc").options(**options).option("query", f"SELECT {key} FROM {name}").load()
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], name, predicates=range_conditions(key, key_ranges(keys, parts)), properties=rest)


def star_sales(spark: SparkSession, folder: str, columns: tuple[str, ...] = tuple(RAW_SALES.names)) -> DataFrame:
    """Raw sales from lineitem, orders, part, customer and nation.

    Every line has its order, part and customer, so a dimension is joined only if
    one of ``columns`` needs it. Customers are joined to orders, which are fewer than
    lines, so only orders are shuffled by customer. Which joins broadcast is left to
    the optimiser, which knows the sizes.
    """
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = set(columns)
    df = read("lineitem")
    if wanted & {"InvoiceDate", "Customer ID", "Country"}:
        orders = read("orders")
        if "Country" in wanted:
            homes = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "Description" in wanted:
        df = df.join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    source = {
        "Invoice": lambda: F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")),
        "StockCode": lambda: F.col("l_partkey").cast("string"),
        "Description": lambda: F.col("p_name"),
        "Quantity": lambda: F.col("l_quantity").cast("int"),
        "InvoiceDate": lambda: F.col("o_orderdate"),
        "Price": lambda: F.col("l_extendedprice") / F.col("l_quantity"),
        "Customer ID": lambda: F.col("o_custkey").cast("double"),
        "Country": lambda: F.col("n_name"),
    }
    return df.select(*(source[c]().alias(c) for c in RAW_SALES.names if c in wanted))
