"""Most frequent value under a fixed tie rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: at or below it a tie goes to the smallest candidate, above it to the largest.
EARLY_HOUR = 6.0


def _tie(lowest: Column, highest: Column) -> Column:
    return F.when(lowest <= EARLY_HOUR, lowest).otherwise(highest)


def mode_of_array(column: str) -> Column:
    """Mode of a column of short arrays, such as the times of the seven days of a week."""
    values = F.col(column)
    freq = F.transform(
        F.array_distinct(values),
        lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), v.alias("v")),
    )
    # The largest (n, v) and the largest (n, -v) hold the ends of the most frequent values.
    highest = F.array_max(freq)["v"]
    lowest = -F.array_max(F.transform(freq, lambda s: F.struct(s["n"], (-s["v"]).alias("v"))))["v"]
    return _tie(lowest, highest)


def mode_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mode of ``value`` per key (or overall for no keys), by counting before comparing."""
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # The smallest and largest of the most frequent values come out of one pass:
    # an ordering on (count, value) and one on (count, -value).
    best = freq.groupBy(*keys).agg(
        F.max(F.struct("_n", F.col(value).alias("v")))["v"].alias("_hi"),
        (-F.max(F.struct("_n", (-F.col(value)).alias("v")))["v"]).alias("_lo"),
    )
    return best.select(*keys, _tie(F.col("_lo"), F.col("_hi")).alias(name))
