"""From raw sales to transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from granary.schemas import RENAMED


DECIDING = ("Customer ID", "Invoice", "Quantity", "Price")


def clean(raw: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Transactions: rows with a customer, not cancelled, quantity and price above zero.

    A row without a customer id (null or NaN) goes; an invoice that begins with a
    capital C is a cancellation, a missing invoice is none; null quantities and
    prices are not above zero. Columns get their stored names. ``counts`` observes
    the number of kept rows in the same pass. The four columns that decide must be
    there, others may be pruned: a missing one is an error, not a rule left out.
    """
    if missing := [c for c in DECIDING if c not in raw.columns]:
        raise ValueError(f"cleaning needs the columns {', '.join(missing)}")
    df = raw.na.drop(subset=["Customer ID"])
    df = df.where(~F.coalesce(F.col("Invoice").cast("string"), F.lit("")).startswith("C"))
    df = df.where((F.col("Quantity") > 0) & (F.col("Price") > 0))
    df = df.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in raw.columns})
    return df.observe(counts, F.count(F.lit(1)).alias("rows")) if counts else df


def is_clean() -> Column:
    """What :func:`clean` keeps, as one condition on raw sales that is never null, to count by."""
    customer, invoice = F.col("Customer ID"), F.coalesce(F.col("Invoice").cast("string"), F.lit(""))
    some = F.coalesce(~F.isnan(customer), F.lit(False))
    return some & ~invoice.startswith("C") & F.coalesce((F.col("Quantity") > 0) & (F.col("Price") > 0), F.lit(False))


def counted(raw: DataFrame) -> DataFrame:
    """(what, n): numbers of raw and of clean sales, in one pass."""
    n = raw.agg(F.count("*").alias("raw"), F.count_if(is_clean()).alias("clean"))
    return n.select(F.explode(F.create_map(F.lit("raw"), "raw", F.lit("clean"), "clean")).alias("what", "n"))


def with_amount(transactions: DataFrame, name: str = "total_sales") -> DataFrame:
    return transactions.withColumn(name, F.col("quantity") * F.col("unit_price"))


def deduplicated(transactions: DataFrame) -> DataFrame:
    """Extra, not part of ``clean``: equal rows once."""
    return transactions.distinct()


def net_of_cancellations(raw: DataFrame) -> DataFrame:
    """Extra: quantity per product, with cancelled quantities subtracted."""
    cancelled = F.coalesce(F.col("Invoice").cast("string"), F.lit("")).startswith("C")
    signed = F.when(cancelled, -F.abs("Quantity")).otherwise(F.col("Quantity"))
    return raw.groupBy(F.col("StockCode").alias("stock_code")).agg(F.sum(signed).alias("net_quantity"))
