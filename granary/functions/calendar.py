"""Calendar labels of timestamps without zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_ending(ts: Column | str) -> Column:
    """Sunday 00:00 of the Monday-to-Sunday week that holds ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.date_trunc("week", ts) + F.expr("interval 6 days")).cast("timestamp_ntz")


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole days of 24 hours between two timestamps."""
    return F.timestamp_diff("DAY", earlier, later)
