"""Declared schemas of the text inputs."""

from __future__ import annotations

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
])

REQUESTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
])

ITEMS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("is_open", T.LongType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("hours", T.MapType(T.StringType(), T.StringType())),
])

REVIEWS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("date", T.StringType()),
])

CHECKINS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("time", T.MapType(T.StringType(), T.LongType())),
])


def users(since_field: str = "member_since") -> T.StructType:
    """Profiles; ``since_field`` is what the file calls the sign-up date."""
    text = ["user_id", "name", since_field, "friends"]
    counts = ["review_count", "fans", "funny", "useful", "cool", "compliment_hot", "compliment_note"]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text]
        + [T.StructField("average_stars", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in counts]
    )
