"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ("user_id", "business_id", "prediction")


def write_predictions(df: DataFrame, path: str, spaced_header: bool = False, mode: str = "errorifexists") -> None:
    """Write ``user_id, item_id, prediction`` as CSV with a header.

    ``spaced_header`` puts the blank after each comma of the header line that some
    consumers of the original layout expect, and ends lines with CR LF.
    """
    out = df.select(
        "user_id", F.col("item_id").alias("business_id"), F.col("prediction").cast("double")
    )
    writer = out.write.mode(mode).option("header", True)
    if spaced_header:
        first, *rest = PREDICTION_COLUMNS
        writer = (
            out.toDF(first, *[f" {c}" for c in rest]).write.mode(mode)
            .option("header", True).option("lineSep", "\r\n")
            .option("ignoreLeadingWhiteSpace", False)
        )
    writer.csv(path)
