"""Distributed readers for the CSV, JSON-lines and JSON-object inputs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateweave import schemas

#: Column for the text of records that can't be parsed.
BROKEN = "_broken"


def file_order() -> Column:
    """A column that orders rows as they stand in their files, and files by path."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def last_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the last in ``file_order``, which is dropped. The fold begins before the shuffle."""
    rest = [c for c in df.columns if c not in (key, "file_order")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "file_order").alias("_last")).select(key, "_last.*")


@dataclass(frozen=True)
class BadRows:
    """What to do with rows that can't be read: set them aside in ``path``, and fail if their share is above ``most_share``."""

    path: str
    most_share: float = 0.01


class TooManyBadRows(ValueError):
    pass


def set_aside(raw: DataFrame, required: Sequence[str], bad: BadRows | None, source: str) -> DataFrame:
    """The rows of ``raw`` that could be read and have all ``required`` columns, without the column of broken records.

    With ``bad``, the others are added to its folder as ``source, reason, record``, and counted by source and reason
    in ``<path>/counts``; without it they are left out silently.
    """
    missing = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required]
    reason = F.coalesce(F.when(F.col(BROKEN).isNotNull(), F.lit("broken")), *missing)
    rest = [c for c in raw.columns if c != BROKEN]
    if bad is not None:
        spark = raw.sparkSession
        others = F.to_json(F.struct(*[c for c in rest if c != "file_order"]))
        marked = raw.withColumn("reason", reason)
        # records and required columns together: Spark doesn't parse a file for its broken records alone
        found = marked.filter("reason is not null").select(F.lit(source).alias("source"), "reason", F.coalesce(BROKEN, others).alias("record"))
        at = f"{bad.path.rstrip('/')}/rows/{source}-{uuid.uuid4().hex}"
        found.write.parquet(at)
        rows = marked.agg(F.count(F.lit(1))).first()[0]
        counts = spark.read.schema(found.schema).parquet(at).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("of", F.lit(rows)).coalesce(1).write.mode("append").parquet(f"{bad.path.rstrip('/')}/counts")
        n_bad = spark.read.schema(found.schema).parquet(at).count()
        if n_bad > bad.most_share * rows:
            raise TooManyBadRows(f"{n_bad} of {rows} rows of {source} can't be read; they are in {at}")
    return raw.filter(reason.isNull()).select(*rest)


def _csv(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    read = spark.read.schema(T.StructType([*schema, T.StructField(BROKEN, T.StringType())]))
    return (
        read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN).csv(path)
    )


def read_ratings(spark: SparkSession, path: str, origin: int = 0, bad: BadRows | None = None) -> DataFrame:
    """``user, item, stars`` by position under a header line, of the rows that have all three.

    ``origin`` says which file a row came from and ``file_order`` where in it, so that the later
    rating can win when the same pair is rated twice.
    """
    raw = _csv(spark, schemas.RATINGS, path).select("*", F.lit(origin).alias("origin"), file_order().alias("file_order"))
    # surplus columns make a row broken for the parser; it is a rating all the same
    raw = raw.withColumn(BROKEN, F.when(F.col("stars").isNull(), F.col(BROKEN)))
    return set_aside(raw, ("user_id", "item_id", "stars"), bad, "ratings")


def read_requests(spark: SparkSession, path: str, bad: BadRows | None = None) -> DataFrame:
    """The first two columns of a CSV with a header, of the rows that have both; a repeated pair stays repeated.

    Rows may carry further columns (a file of known ratings can serve as requests), so
    the surplus is dropped without a warning per file.
    """
    raw = _csv(spark, schemas.REQUESTS, path)
    raw = raw.withColumn(BROKEN, F.when(F.col("item_id").isNull(), F.col(BROKEN)))
    return set_aside(raw, ("user_id", "item_id"), bad, "requests")


def _json(spark: SparkSession, schema: T.StructType, path: str, required: Sequence[str], bad: BadRows | None, source: str) -> DataFrame:
    read = spark.read.schema(T.StructType([*schema, T.StructField(BROKEN, T.StringType())]))
    raw = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    return set_aside(raw.select("*", file_order().alias("file_order")), required, bad, source)


def read_items(spark: SparkSession, path: str, bad: BadRows | None = None) -> DataFrame:
    items = _json(spark, schemas.ITEMS, path, ("business_id",), bad, "items")
    return last_per_key(items.withColumnRenamed("business_id", "item_id"), "item_id")


def read_users(spark: SparkSession, path: str, since_field: str = "member_since", bad: BadRows | None = None) -> DataFrame:
    users = _json(spark, schemas.users(since_field), path, ("user_id",), bad, "users")
    return last_per_key(users.withColumnRenamed(since_field, "member_since"), "user_id")


def read_reviews(spark: SparkSession, path: str, bad: BadRows | None = None) -> DataFrame:
    return (
        _json(spark, schemas.REVIEWS, path, ("user_id", "business_id", "stars"), bad, "reviews")
        .withColumnRenamed("business_id", "item_id")
        .withColumnRenamed("date", "rated_on")
    )


def read_checkins(spark: SparkSession, path: str, bad: BadRows | None = None) -> DataFrame:
    checkins = _json(spark, schemas.CHECKINS, path, ("business_id",), bad, "checkins")
    return last_per_key(checkins.withColumnRenamed("business_id", "item_id"), "item_id")


def read_lookup(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects ``{key: code}`` as a table with one row per key: one object per file, or with ``lines`` one per line."""
    as_map = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    rows = spark.read.text(path, wholetext=not lines).select("value", file_order().alias("file_order"))
    return last_per_key(rows.select(F.explode(as_map).alias("lookup_key", "code"), "file_order"), "lookup_key")
