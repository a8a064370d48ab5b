import statistics

import pytest
from pyspark.sql import functions as F

from rateweave.functions import mode, scalar
from rateweave.operators import features, social
from rateweave.operators.ratings import dedupe_last, rating_table

USERS = """user_id long, name string, average_stars double, review_count long, member_since string, fans long,
funny long, useful long, cool long, compliment_hot long, compliment_note long, friends string"""
ITEMS = """item_id long, stars double, review_count long, is_open long, latitude double, longitude double,
attributes map<string,string>, hours map<string,string>"""


@pytest.fixture(scope="module")
def sources(spark):
    users = spark.createDataFrame([
        (1, "Ada", 4.0, 10, "2012-03-04", 2, 1, 2, 3, 1, 0, "2, 3, 3"),
        (2, "BOB", 0.0, 20, "2015-01-02", 0, 0, 4, 0, 0, 1, "None"),
        (3, "Kim", 2.0, 0, "2010-12-31", None, None, None, None, None, None, ""),
        (4, "ada", 3.0, 6, "2011-01-01", 1, 1, 0, 0, 0, 0, None),
    ], USERS)
    items = spark.createDataFrame([
        (1, 4.5, 7, 1, 10.0, -20.0, {"GoodForKids": "True", "WiFi": "no", "RestaurantsPriceRange2": "3"},
         {"Mon": "11:30-21:0", "Tue": "9:0-3:0"}),
        (2, 0.0, 3, 0, None, 0.0, {"GoodForKids": "true", "RestaurantsGoodForGroups": "False",
                                   "RestaurantsPriceRange2": "x"}, {}),
        (3, 1.5, 2, 1, 1.0, 2.0, None, None),
        (4, 3.0, 0, 0, 1.0, 2.0, {"WiFi": "free"}, {"Mon": "0:0-22:0", "Tue": "0:0-20:0"}),
    ], ITEMS)
    reviews = spark.createDataFrame([
        (1, 1, 5.0, "2016-01-01"), (1, 2, 3.0, "2016-01-05"), (2, 1, 2.0, "2016-02-01"), (3, 1, 4.0, "2017-02-01"),
        (9, 3, 1.0, "2016-02-02"),
    ], "user_id long, item_id long, stars double, rated_on string")
    checkins = spark.createDataFrame([(1, {"Fri-0": 2, "Sat-1": 5}), (3, {})], "item_id long, time map<string,long>")
    lookup = spark.createDataFrame([("ada", "F"), ("bob", "M")], "lookup_key string, code string")
    return features.Sources(users, items, reviews, checkins, lookup)


@pytest.fixture(scope="module")
def frame(spark, sources):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 3), (77, 88), (1, 3)], "user_id long, item_id long")
    out = features.feature_frame(
        pairs, sources, features.feature_tables(sources), rating_table(sources.reviews)
    ).collect()
    assert len(out) == 6
    return {(r.user_id, r.item_id): r.asDict() for r in out}


def test_known_pair(frame):
    row = frame[1, 1]
    want = {
        "user_avg_stars": 4, "item_avg_stars": 4.5, "stars_product": 18, "user_review_count": 10,
        "item_review_count": 7, "fans": 2, "item_raters": 3, "user_ratings": 2, "latitude": 10, "longitude": -20,
        "good_for_groups": 0, "member_since": 20120304, "wifi_no": 1, "wifi_na": 0, "price_range": 3,
        "good_for_kids": 1, "checkin_slots": 2, "funny": 1, "useful": 2, "cool": 3, "votes_sum": 6,
        "compliment_hot": 1, "compliment_note": 0, "friend_count": 3, "lookup_code": 1, "days_open": 2,
        "opening_time": (11.3 + 9) / 2, "closing_time": 3,
        "user_date_var": statistics.variance([20160101, 20160105]),
        # Friends 2, 3, 3 rated item 1 with 2, 4, 4.
        "friend_item_mean": 10 / 3,
    }
    assert set(want) == set(features.FEATURES)
    for name, value in want.items():
        assert row[name] == pytest.approx(value), name


def test_gaps_are_filled_by_rule(frame):
    stars = (4.5 + 0 + 1.5 + 3) / 4
    row = frame[2, 2]
    assert row["user_avg_stars"] == row["item_avg_stars"] == pytest.approx(stars)  # zero counts as missing
    assert row["latitude"] == row["longitude"] == 0
    assert row["good_for_kids"] == 1 and row["good_for_groups"] == 0
    assert row["wifi_na"] == 1 and row["price_range"] == 0
    assert row["days_open"] == 2  # mean over items with hours
    assert row["opening_time"] == pytest.approx((20.3 / 2 + 0) / 4)  # midnight and closed items count as rows only
    assert row["friend_count"] == 0 and row["friend_item_mean"] is None
    assert row["lookup_code"] == 0
    assert row["user_date_var"] == 0

    row = frame[3, 4]
    assert row["opening_time"] == pytest.approx((20.3 / 2) / 4)  # midnight is replaced
    assert row["closing_time"] == 22.0  # tie above six goes to the largest
    assert row["fans"] == row["funny"] == row["compliment_hot"] == 0
    assert row["useful"] == pytest.approx(2) and row["cool"] == pytest.approx(1)
    assert row["user_review_count"] == 0  # zero is a value here
    assert row["lookup_code"] is None
    assert row["checkin_slots"] == 0 and row["wifi_na"] == 0 and row["wifi_no"] == 0
    assert row["friend_count"] == 0


def test_unknown_pair(frame):
    row = frame[77, 88]
    assert row["member_since"] == 20150103
    assert row["wifi_na"] == row["wifi_no"] == row["price_range"] == row["good_for_kids"] == 0
    assert row["user_ratings"] == pytest.approx(5 / 4) and row["item_raters"] == pytest.approx(5 / 3)
    assert row["user_review_count"] == 9 and row["item_review_count"] == 3
    assert row["friend_count"] == pytest.approx(3 / 4)
    assert row["closing_time"] == 3.0  # modes 3 and 22 tie; the smaller is early
    assert row["friend_item_mean"] is None and row["lookup_code"] is None


def test_friend_fallback(frame):
    # Friends 2, 3, 3 did not rate item 3; their averages are 0, 2, 2.
    assert frame[1, 3]["friend_item_mean"] == pytest.approx(4 / 3)
    assert frame[4, 3]["friend_item_mean"] is None


def test_both_friend_routes_agree(spark):
    users = spark.createDataFrame(
        [(1, ", ".join(str(k) for k in range(2, 40)) + ", 5"), (2, "3, 5"), (3, "None")], "user_id long, friends string"
    )
    rated = [(u, 100, float(u % 5 + 1)) for u in range(3, 30)] + [(5, 200, 4.0), (7, 200, 1.0)]
    table = rating_table(spark.createDataFrame(rated, "user_id long, item_id long, stars double"))
    pairs = spark.createDataFrame([(1, 100), (1, 200), (2, 100), (2, 200), (3, 100)], "user_id long, item_id long")
    edges = social.weighted_edges(users, pairs)
    got = {(r.user_id, r.item_id): (r.friend_item_mean, r.n_friend_ratings)
           for r in social.friend_item_mean(pairs, edges, table).collect()}
    last = {(u, i): s for u, i, s in rated}
    lists = {1: list(range(2, 40)) + [5], 2: [3, 5]}
    for (u, i) in [(1, 100), (1, 200), (2, 100), (2, 200)]:
        found = [last[f, i] for f in lists[u] if (f, i) in last]
        assert got[u, i] == (pytest.approx(sum(found) / len(found)), len(found))
    assert (3, 100) not in got


def test_training_frame_has_all_rows(spark, sources):
    val = spark.createDataFrame([(1, 1, "2.0")], "user_id long, item_id long, stars string")
    out = features.training_frame(
        val, sources, features.feature_tables(sources), rating_table(sources.reviews)
    )
    assert tuple(out.columns) == ("user_id", "item_id", "label", *features.FEATURES)
    assert sorted(r.label for r in out.collect()) == [1, 2, 2, 3, 4, 5]


def test_friends_are_joined_while_rows_are_narrow(spark, sources):
    val = spark.createDataFrame([(1, 1, "2.0")], "user_id long, item_id long, stars string")
    out = features.training_frame(
        val, sources, features.feature_tables(sources), rating_table(sources.reviews)
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    outermost = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "item_id" in outermost and "user_id" not in outermost


def test_last_rating_wins(spark):
    rows = [(1, 1, 2.0, 1), (1, 1, 5.0, 3), (1, 1, 4.0, 2), (2, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, stars double, ord int")
    assert sorted(tuple(r) for r in dedupe_last(df, ["user_id", "item_id"], "stars", ["ord"]).collect()) == [
        (1, 1, 5.0), (2, 1, 1.0)]
    first = [r for r in rating_table(df, ["ord"]).collect() if r.user_id == 1][0]
    assert (first.stars, first.copies, first.stars_sum) == (5.0, 3, 11.0)


def test_scalar_functions(spark):
    df = spark.range(1)
    def value(column):
        return df.select(column.alias("v")).first().v
    for r in range(1, 6):
        assert value(scalar.linear_interp(F.lit(-float(r)), -5, -1, 1, 5)) == 6 - r
    assert value(scalar.linear_interp(F.lit(5.0), 0, 10, 0, 1)) == 0.5
    assert [value(scalar.clip(F.lit(x), 1, 5)) for x in (0.0, 2.5, 9.0)] == [1, 2.5, 5]
    assert value(scalar.clip(F.lit(None).cast("double"), 1, 5)) is None
    assert value(scalar.clock(F.lit("11:30"))) == 11.3 and value(scalar.clock(F.lit("2:5"))) == 2.5
    assert value(scalar.date_code(F.lit("2016-01-09"))) == 20160109 and value(scalar.date_code(F.lit("?"))) is None
    assert value(scalar.amplify(F.lit(-0.25))) == pytest.approx(0.25 ** 2.5)
    assert [value(scalar.list_length(F.lit(t))) for t in ("a, b", "a", "", "None")] == [2, 1, 0, 0]
    assert [value(scalar.binary_flag(F.lit(t))) for t in ("True", "true", "False", "no")] == [1, 1, 0, 0]


@pytest.mark.parametrize("values, want", [
    ([9.0, 5.0, 9.0, 5.0], 5.0), ([9.0, 7.0], 9.0), ([3.0, 3.0, 8.0], 3.0), ([22.0, 21.0, 22.0], 22.0), ([6.0, 20.0], 6.0),
])
def test_mode_ties(spark, values, want):
    df = spark.createDataFrame([(1, values)], "k int, a array<double>")
    assert df.select(mode.mode_of_array("a").alias("m")).first().m == want
    long_form = df.select("k", F.explode("a").alias("v"))
    assert mode.mode_by(long_form, ["k"], "v", "m").first().m == want
    assert mode.mode_by(long_form, [], "v", "m").first().m == want
