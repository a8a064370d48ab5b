"""Error reports on ``label`` and ``prediction``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 5


def rmse(df: DataFrame) -> DataFrame:
    error = F.col("label") - F.col("prediction")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))


def error_histogram(df: DataFrame) -> DataFrame:
    """Rows per whole-star error bucket 0..4, where 4 holds all larger errors too.

    Errors are rounded to nine places first, so one that is a whole number up to floating
    noise lands in its own bucket.
    """
    bucket = F.least(F.floor(F.round(F.abs(F.col("label") - F.col("prediction")), 9)), F.lit(BUCKETS - 1))
    counts = df.agg(*[F.count(F.when(bucket == b, 1)).alias(f"b{b}") for b in range(BUCKETS)])
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}").alias("n")) for b in range(BUCKETS)])
    return counts.select(F.inline(rows))
