"""Roundings and exact sums."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(x: Column, places: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back (as NumPy rounds)."""
    return F.rint(x * float(10**places)) / float(10**places)


def round_exact(x: Column, places: int = 2) -> Column:
    """``x`` to so many places as its exact binary value is rounded, halves to even.

    The product with the power of ten is taken without error, as a double and the
    rest that it lacks (the factor's halves are exact), and the fraction of both decides.
    """
    power = float(10**places)
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    product = a * power
    rest = (high * power - product) + (a - high) * power
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + rest
    up = F.when(over == 0, whole % 2 == 1).otherwise(over > 0)
    return F.when(product >= 2.0**52, x).otherwise(F.signum(x) * (whole + up.cast("double")) / power)


def exact_sum(x: Column, places: int = 4) -> Column:
    """Sum of doubles by way of decimals: alike in any order of the rows."""
    return F.sum(x.cast(f"decimal(18,{places})")).cast("double")


def standardised(x: Column, mean: Column, deviation: Column) -> Column:
    """(x - mean) / deviation, 0 where the deviation is 0."""
    return F.when(deviation == 0, 0.0).otherwise((x - mean) / deviation)
