"""The 30-column feature frame.

Each source is reduced to one row per user or per item, then a row of pairs needs two
left joins. Gaps are filled afterwards from one-row aggregates of the sources, which
stay in the plan as scalar subqueries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.functions import mode, scalar
from rateweave.functions.impute import Rule, impute
from rateweave.operators.ratings import PAIR, activity_counts, rating_table, union_ratings
from rateweave.operators.social import friend_feature
from rateweave.session import materialize, together

# The features in the order the models expect, with their imputation rules.
# A feature without a rule is worked out from features before it.
RULES: dict[str, Rule | None] = {
    "user_avg_stars": Rule("average_stars", "item_stars_mean", zero_is_missing=True),
    "item_avg_stars": Rule("item_stars", "item_stars_mean", zero_is_missing=True),
    "user_date_var": Rule("date_var", "date_var_mean"),
    "user_review_count": Rule("user_review_count", "user_review_count_mean"),
    "item_review_count": Rule("item_review_count", "item_review_count_mean"),
    "fans": Rule("fans"),
    "item_raters": Rule("item_events", "item_events_mean"),
    "user_ratings": Rule("user_events", "user_events_mean"),
    "stars_product": None,
    "latitude": Rule("latitude", zero_is_missing=True),
    "longitude": Rule("longitude", zero_is_missing=True),
    "good_for_groups": Rule("good_for_groups"),
    "member_since": Rule("since_code", "since_code_next", zero_is_missing=True),
    "wifi_no": Rule("wifi_no"),
    "wifi_na": Rule("wifi_na"),
    "price_range": Rule("price_range"),
    "good_for_kids": Rule("good_for_kids"),
    "checkin_slots": Rule("checkin_slots"),
    "funny": Rule("funny"),
    "useful": Rule("useful", "useful_mean"),
    "cool": Rule("cool", "cool_mean"),
    "votes_sum": None,
    "compliment_hot": Rule("compliment_hot"),
    "compliment_note": Rule("compliment_note"),
    "friend_count": Rule("friend_count", "friend_count_mean"),
    "lookup_code": Rule("lookup_code", None),
    "days_open": Rule("days_open", "days_open_mean", zero_is_missing=True),
    "opening_time": Rule("opening_time", "opening_time_mean", zero_is_missing=True),
    "closing_time": Rule("closing_time", "closing_time_mode", zero_is_missing=True),
    "friend_item_mean": Rule("friend_item_mean", None),
}
FEATURES = tuple(RULES)


@dataclass(frozen=True)
class Sources:
    """The inputs of the feature frame."""

    users: DataFrame
    items: DataFrame
    reviews: DataFrame
    checkins: DataFrame
    #: Codes by name; without it, no user has one.
    lookup: DataFrame | None = None
    #: Review columns that order repeated reviews of a pair; the last one counts.
    order: tuple[str, ...] = ("rated_on",)


def store(s: Sources) -> Sources:
    """The sources with users and reviews parsed once; several steps read them."""
    columns = dict.fromkeys(["user_id", "item_id", "stars", "rated_on", *s.order])
    users, reviews = together(
        lambda: materialize(s.users, "users"),
        lambda: materialize(s.reviews.select(*columns), "review-events"),
    )
    return replace(s, users=users, reviews=reviews)


def with_lookup_code(users: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """``users`` with ``lookup_code``: 1 for code F, 0 for M, null where the name is not listed."""
    if lookup is None:
        return users.withColumn("lookup_code", F.lit(None).cast("double"))
    code = F.when(F.col("code") == "F", F.lit(1.0)).when(F.col("code") == "M", F.lit(0.0))
    return (
        users.withColumn("lookup_key", F.lower("name"))
        .join(lookup, "lookup_key", "left")
        .withColumn("lookup_code", code)
        .drop("lookup_key", "code")
    )


def user_profiles(users: DataFrame, lookup: DataFrame | None) -> DataFrame:
    return with_lookup_code(users, lookup).select(
        "user_id", "average_stars", F.col("review_count").alias("user_review_count"),
        scalar.date_code(F.col("member_since")).alias("since_code"),
        "fans", "funny", "useful", "cool", "compliment_hot", "compliment_note",
        scalar.list_length(F.col("friends")).alias("friend_count"), "lookup_code",
    )


def item_profiles(items: DataFrame) -> DataFrame:
    attributes, hours = F.col("attributes"), F.col("hours")
    open_days = scalar.non_empty(hours)
    known = F.lit(True)
    wifi = scalar.map_get(attributes, "WiFi")
    # The times are columns of their own, so that the expressions on them share one evaluation.
    timed = items.withColumns({
        "_opens": F.when(open_days, scalar.opening_times(hours)),
        "_closes": F.when(open_days, scalar.closing_times(hours)),
    })
    return timed.select(
        "item_id", F.col("stars").alias("item_stars"), F.col("review_count").alias("item_review_count"),
        impute(F.col("is_open"), 0).alias("is_open"), "latitude", "longitude",
        scalar.binary_flag(scalar.map_get(attributes, "GoodForKids")).alias("good_for_kids"),
        scalar.binary_flag(scalar.map_get(attributes, "RestaurantsGoodForGroups")).alias("good_for_groups"),
        scalar.one_hot(wifi, "no", known).alias("wifi_no"),
        scalar.one_hot(wifi, "n/a", known).alias("wifi_na"),
        scalar.int_or_zero(scalar.map_get(attributes, "RestaurantsPriceRange2")).alias("price_range"),
        F.when(open_days, F.size(hours)).alias("days_open"),
        scalar.array_mean(F.col("_opens")).alias("opening_time"),
        mode.mode_of_array("_closes").alias("closing_time"),
    )


def user_activity(reviews: DataFrame) -> DataFrame:
    """Events and date variance per user, in one aggregation."""
    code = scalar.date_code(F.col("rated_on"))
    return reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_events"),
        F.coalesce(F.var_samp(code), F.lit(0.0)).alias("date_var"),
    )


def item_activity(reviews: DataFrame) -> DataFrame:
    return activity_counts(reviews, "item_id").withColumnRenamed("n_events", "item_events")


def checkin_slots(checkins: DataFrame) -> DataFrame:
    return checkins.select(
        "item_id", F.coalesce(F.size(F.map_values("time")), F.lit(0)).alias("checkin_slots")
    )


def user_features(s: Sources) -> DataFrame:
    """Everything known per user: profile and review activity, whichever exist."""
    return user_profiles(s.users, s.lookup).join(user_activity(s.reviews), "user_id", "full")


def item_features(s: Sources) -> DataFrame:
    """Everything known per item; ``has_profile`` marks items of the item source."""
    return (
        item_profiles(s.items).withColumn("has_profile", F.lit(True))
        .join(item_activity(s.reviews), "item_id", "full")
        .join(checkin_slots(s.checkins), "item_id", "full")
    )


@dataclass(frozen=True)
class FeatureTables:
    """One row per user and one row per item, written once."""

    users: DataFrame
    items: DataFrame


def feature_tables(s: Sources) -> FeatureTables:
    return FeatureTables(*together(
        lambda: materialize(user_features(s), "user-features"),
        lambda: materialize(item_features(s), "item-features"),
    ))


@dataclass(frozen=True)
class Stored:
    """All that feature frames are made from, written once: stored sources, their feature tables and the rating table of the reviews."""

    sources: Sources
    tables: FeatureTables
    reviewed: DataFrame


def stored(s: Sources | Stored) -> Stored:
    """What frames of any pairs start from; what is stored already stays as it is."""
    if isinstance(s, Stored):
        return s
    s = store(s)
    tables, reviewed = together(lambda: feature_tables(s), lambda: materialize(rating_table(s.reviews, s.order), "reviews"))
    return Stored(s, tables, reviewed)


def constants(t: FeatureTables) -> dict[str, Column]:
    """The stand-in values: one aggregate per feature table, plus the most frequent closing time.

    A column that comes from one source only is null for rows of the others, so plain
    means are over that source alone.
    """
    user_values = {
        "user_review_count_mean": F.avg("user_review_count"),
        "since_code_next": F.max("since_code") + 1,
        "useful_mean": F.avg("useful"),
        "cool_mean": F.avg("cool"),
        "friend_count_mean": F.avg("friend_count"),
        "date_var_mean": F.avg("date_var"),
        "user_events_mean": F.avg("user_events"),
    }
    item_values = {
        "item_stars_mean": F.avg("item_stars"),
        "item_review_count_mean": F.avg("item_review_count"),
        "days_open_mean": F.avg("days_open"),
        # Openings at midnight add nothing to the sum, yet every profile counts.
        "opening_time_mean": F.sum("opening_time") / F.count("has_profile"),
        "item_events_mean": F.avg("item_events"),
    }
    out: dict[str, Column] = {}
    for table, values in ((t.users, user_values), (t.items, item_values)):
        row = table.agg(F.struct(*[v.cast("double").alias(k) for k, v in values.items()]).alias("row")).scalar()
        out.update({name: row[name] for name in values})
    closing = t.items.filter(F.col("closing_time") != 0)
    out["closing_time_mode"] = mode.mode_by(closing, (), "closing_time", "m").scalar()
    return out


def fill_gaps(raw: DataFrame, stand_ins: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """Apply the rules and add the two features made from others."""
    def default(rule: Rule) -> Column | float | None:
        return stand_ins[rule.default] if isinstance(rule.default, str) else rule.default

    filled = raw.select(
        *keep,
        *[
            impute(F.col(rule.source), default(rule), rule.zero_is_missing).alias(name)
            for name, rule in RULES.items() if rule is not None
        ],
    )
    return filled.withColumns({
        "stars_product": F.col("user_avg_stars") * F.col("item_avg_stars"),
        "votes_sum": F.col("funny") + F.col("useful") + F.col("cool"),
    }).select(*keep, *FEATURES)


def feature_frame(pairs: DataFrame, s: Sources, t: FeatureTables, table: DataFrame) -> DataFrame:
    """The features of each row of ``pairs``; further columns of ``pairs`` are kept.

    ``table`` is the rating table of the reviews.
    """
    keep = tuple(pairs.columns)
    friends = friend_feature(pairs.select(*PAIR).distinct(), s.users, table)
    # The one value of friends comes first, while rows are narrow; each wide table is joined as late as can be.
    raw = (
        pairs.join(friends, list(PAIR), "left")
        .join(t.users, "user_id", "left")
        .join(t.items, "item_id", "left")
    )
    return fill_gaps(raw, constants(t), keep)


def labelled_ratings(reviews: DataFrame, validation: DataFrame | None) -> DataFrame:
    """Pairs with their rating as label, of the reviews and, if given, the validation ratings."""
    parts = [
        part.select(*PAIR, F.col("stars").cast("double").alias("label"))
        for part in (reviews, validation) if part is not None
    ]
    return union_ratings(*parts)


def training_frame(
    validation: DataFrame, s: Sources, t: FeatureTables, table: DataFrame
) -> DataFrame:
    """Features and label of every review and every validation rating."""
    return feature_frame(labelled_ratings(s.reviews, validation), s, t, table)
