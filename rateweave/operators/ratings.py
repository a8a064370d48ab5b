"""Operators on rating events ``(user_id, item_id, stars, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rateweave.session import cut_lineage, spread

PAIR = ("user_id", "item_id")
#: Ratings are summed as whole thousandths, so that sums don't depend on the order of rows.
RATING_UNITS = 1000


def units(stars: Column) -> Column:
    """A rating (or a sum of ratings) as a whole number of thousandths."""
    return F.round(stars * RATING_UNITS).cast("long")


def union_ratings(*parts: DataFrame) -> DataFrame:
    """All events of all parts."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def dedupe_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row per key, holding the value of the last row in ``order`` (value breaks ties)."""
    rank = F.struct(*order, value)
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias(value))


def rating_table(events: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per (user, item): last rating, number of events and their sum.

    Every later operator starts here, so repeated events are folded once, on the map
    side, before anything is joined. Events without user, item or rating are not ratings and are left out.
    """
    rated = events.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("stars").isNotNull())
    return rated.groupBy(*PAIR).agg(
        F.max_by("stars", F.struct(*order, "stars")).alias("stars"),
        F.count(F.lit(1)).alias("copies"),
        (F.sum(units(F.col("stars"))) / RATING_UNITS).alias("stars_sum"),
    )


def entity_stats(table: DataFrame, key: str) -> DataFrame:
    """Per user or item: number of events, distinct partners and mean over the events."""
    return (
        table.groupBy(key)
        .agg(
            F.sum("copies").alias("events"),
            F.count(F.lit(1)).alias("partners"),
            F.sum(units(F.col("stars_sum"))).alias("_total"),
        )
        .select(key, "events", "partners", (F.col("_total") / RATING_UNITS / F.col("events")).alias("mean_stars"))
    )


def global_mean(table: DataFrame) -> Column:
    """Mean of the last ratings, as a scalar subquery."""
    return table.agg(F.sum(units(F.col("stars"))) / RATING_UNITS / F.count("stars")).scalar()


def group_members(table: DataFrame, key: str, member: str) -> DataFrame:
    """``key, member, copies``: the members of each key and their numbers of events, one row each.

    The long form of a list per key: a key with any number of members stays spread over tasks. A rating table has a row per pair,
    so there is nothing to fold before rows are moved.
    """
    return spread(table, key, member, rows=table.count()).groupBy(key, member).agg(F.sum("copies").alias("copies"))


def activity_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))


def fold_requests(requests: DataFrame) -> DataFrame:
    """One row per requested pair with its number of copies."""
    return requests.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("copies"))


def expand_copies(df: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Undo ``fold_requests``: one row per copy, numbered from 1 within the pair.

    A pair asked for very often is first split into chunks that are dealt out to
    different tasks, so no task writes all copies of one pair.
    """
    last_chunk = F.floor((F.col("copies") - 1) / F.lit(chunk))
    first = F.col("_chunk") * chunk + 1
    last = F.least(F.col("copies"), (F.col("_chunk") + 1) * chunk)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
        .repartition(*PAIR, "_chunk")
        .withColumn("copy_no", F.explode(F.sequence(first, last)))
        .drop("_chunk", "copies")
    )


def number_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``row_no``, its place in ``order`` counted from 0.

    The sort stays spread over range partitions. A row's number is its place within
    its partition plus the sizes of the partitions before it; only those sizes, one row
    per partition, are ever summed in one place.
    """
    # Checkpointed: the partition bounds come from a sample, and sizes and rows must see the same ones.
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(starts, "_part")
        .withColumn("row_no", F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )


def row_range(df: DataFrame, order: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Rows number ``lo`` to ``hi`` - 1 in ``order``."""
    return number_rows(df, order).filter((F.col("row_no") >= lo) & (F.col("row_no") < hi))
