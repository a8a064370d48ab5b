"""The registered queries: name -> (spark, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rateweave.catalog.inputs import ORDER, Inputs
from rateweave.functions import mode, scalar
from rateweave.functions.impute import impute
from rateweave.operators import boosting, cf, evaluate, features, hybrid, models, ratings, social
from rateweave.operators.ratings import PAIR
from rateweave.plans import pipeline
from rateweave.session import fresh_path, materialize, together
from rateweave.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]

DEALT = cf.CFOptions(pairs_per_split=200)
#: Trees per model in the queries that check facts about fitted models, and in the bench; all else is as in the full models, which ``gbt_predict`` and ``hybrid_predict`` fit.
TREES = 10
QUICK_A, QUICK_B = (replace(b, trees=TREES) for b in (models.MODEL_A, models.MODEL_B))


def _r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def _events(i: Inputs) -> DataFrame:
    return ratings.union_ratings(i.train(), i.val())


def _table(i: Inputs) -> DataFrame:
    return ratings.rating_table(_events(i), ORDER)


def _stored_table(i: Inputs) -> DataFrame:
    return materialize(_table(i), "ratings")


def _reviewed(i: Inputs) -> DataFrame:
    return ratings.rating_table(i.reviews(), ORDER)


def _pairs(i: Inputs) -> DataFrame:
    return ratings.fold_requests(i.requests()).select(*PAIR)


def sources(i: Inputs) -> features.Sources:
    return features.Sources(i.users(), i.items(), i.reviews(), i.checkins(), i.lookup(), ORDER)


def stored_sources(i: Inputs) -> features.Stored:
    return features.stored(sources(i))


# --- sources and sinks -------------------------------------------------------


def scan_ratings(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "ratings-csv")
    Inputs(spark, sf).train().select(*PAIR, "stars").write.option("header", True).csv(path)
    return readers.read_ratings(spark, path).drop("origin", "file_order")


def scan_bad_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """A file in which some ratings are no numbers and some rows break off: what is read, and what is set aside for which reason."""
    path, aside = fresh_path(spark, "ratings-csv"), fresh_path(spark, "bad-rows")
    stars = F.when(F.col("item_id") % 50 == 3, F.lit("n/a")).when(F.col("item_id") % 50 == 4, F.lit(None)).otherwise(F.col("stars").cast("string"))
    Inputs(spark, sf).train().select(*PAIR, stars.alias("stars")).write.option("header", True).csv(path)
    read = readers.read_ratings(spark, path, bad=readers.BadRows(aside, most_share=0.5))
    good = read.agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum(ratings.units(F.col("stars"))).alias("thousandths"))
    counts = spark.read.parquet(f"{aside}/counts").select("reason", "n", F.lit(None).cast("long").alias("thousandths"))
    return good.unionByName(counts)


def scan_users_last(spark: SparkSession, sf: str) -> DataFrame:
    """A file that holds every profile up to three times: the last one of each user counts."""
    path = fresh_path(spark, "users-json")
    users = Inputs(spark, sf).users().select("user_id", "average_stars", "review_count")
    times = users.withColumn("version", F.explode(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))))
    changed = times.withColumn("review_count", F.col("review_count") + 1000 * F.col("version"))
    changed.repartition("user_id").sortWithinPartitions("user_id", "version").drop("version").write.json(path)
    return readers.read_users(spark, path).select("user_id", _r("average_stars"), "review_count")


def scan_requests(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "requests-csv")
    Inputs(spark, sf).requests().write.option("header", True).csv(path)
    return ratings.fold_requests(readers.read_requests(spark, path))


def scan_json_items(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "items-json")
    Inputs(spark, sf).items().withColumnRenamed("item_id", "business_id").write.json(path)
    a = F.col("attributes")
    return readers.read_items(spark, path).select(
        "item_id", "stars", "review_count", "is_open", _r("latitude"), "longitude",
        scalar.map_get(a, "GoodForKids").alias("good_for_kids"),
        scalar.map_get(a, "RestaurantsGoodForGroups").alias("good_for_groups"),
        scalar.map_get(a, "WiFi").alias("wifi"),
        scalar.map_get(a, "RestaurantsPriceRange2").alias("price_range"),
        F.coalesce(F.size("hours"), F.lit(0)).cast("bigint").alias("n_days"),
        scalar.map_get(F.col("hours"), "1").alias("monday"),
    )


def scan_lookup_map(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    path = fresh_path(spark, "lookup-json")
    i.lookup().select(F.to_json(F.create_map("lookup_key", "code")).alias("value")).write.text(path)
    names = i.users().groupBy(F.lower("name").alias("lookup_key")).agg(F.count("user_id").alias("n_users"))
    return (
        readers.read_lookup(spark, path, lines=True).join(names, "lookup_key", "left")
        .select("lookup_key", "code", F.coalesce("n_users", F.lit(0)).alias("n_users"))
    )


def sink_predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "predictions-csv")
    sinks.write_predictions(_blended(Inputs(spark, sf).store()), path)
    back = spark.read.schema("user_id string, item_id string, prediction double").option("header", True).csv(path)
    return back.select(*PAIR, _r("prediction"))


# --- projections, filters, scalar functions ----------------------------------


def filter_present_map(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).items().filter(scalar.non_empty(F.col("hours"))).select("item_id")


def row_range_slice(spark: SparkSession, sf: str) -> DataFrame:
    people = Inputs(spark, sf).bag().select("user_id").distinct()
    return ratings.row_range(people, ["user_id"], 100, 1000)


def friend_edges(spark: SparkSession, sf: str) -> DataFrame:
    return social.friend_edges(Inputs(spark, sf).users())


def feat_friend_count(spark: SparkSession, sf: str) -> DataFrame:
    count = scalar.list_length(F.col("friends")).cast("bigint")
    return Inputs(spark, sf).users().select("user_id", count.alias("friend_count"))


def feat_days_open(spark: SparkSession, sf: str) -> DataFrame:
    open_items = Inputs(spark, sf).items().filter(scalar.non_empty(F.col("hours")))
    return open_items.select("item_id", F.size("hours").cast("bigint").alias("days_open"))


def feat_checkin_slots(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    return i.items().select("item_id").join(features.checkin_slots(i.checkins()), "item_id", "left").select(
        "item_id", F.coalesce("checkin_slots", F.lit(0)).cast("bigint").alias("checkin_slots")
    )


def feat_binary_attr(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attributes")
    return Inputs(spark, sf).items().select(
        "item_id",
        scalar.binary_flag(scalar.map_get(a, "GoodForKids")).alias("good_for_kids"),
        scalar.binary_flag(scalar.map_get(a, "RestaurantsGoodForGroups")).alias("good_for_groups"),
    )


def feat_onehot_attr(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    wifi = i.items().select(
        "item_id", scalar.map_get(F.col("attributes"), "WiFi").alias("wifi"), F.lit(True).alias("known")
    )
    known = F.col("known").isNotNull()
    return _pairs(i).join(wifi, "item_id", "left").select(*PAIR, *[
        scalar.one_hot(F.col("wifi"), answer, known).alias(name)
        for name, answer in (("wifi_no", "no"), ("wifi_na", "n/a"), ("wifi_free", "free"))
    ])


def feat_price_range(spark: SparkSession, sf: str) -> DataFrame:
    price = scalar.int_or_zero(scalar.map_get(F.col("attributes"), "RestaurantsPriceRange2"))
    return Inputs(spark, sf).items().select("item_id", price.alias("price_range"))


def feat_member_since(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    codes = i.users().select("user_id", scalar.date_code(F.col("member_since")).alias("code"))
    following = codes.agg(F.max("code") + 1).scalar()
    return _pairs(i).join(codes, "user_id", "left").select(
        *PAIR, F.coalesce(F.nullif("code", F.lit(0)), following).alias("member_since")
    )


def feat_hours_parse(spark: SparkSession, sf: str) -> DataFrame:
    days = Inputs(spark, sf).items().select("item_id", F.explode("hours").alias("day", "span"))
    one_day = F.create_map(F.lit("day"), F.col("span"))
    return days.select(
        "item_id", F.col("day").cast("bigint").alias("day"),
        scalar.opening_times(one_day)[0].alias("opens"), scalar.closing_times(one_day)[0].alias("closes"),
    )


def dict_encode(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    return features.with_lookup_code(i.users(), i.lookup()).select("user_id", "lookup_code")


def feat_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(Inputs(spark, sf).store()).select(*PAIR, _r("stars_product"), _r("votes_sum"))


def linear_interp(spark: SparkSession, sf: str) -> DataFrame:
    stars = F.col("stars")
    return _events(Inputs(spark, sf)).select(
        *PAIR, "ord1", "ord2", scalar.reflect_rating(stars, F.lit(-1.0)).alias("mirrored"),
        F.round(scalar.linear_interp(stars, 1, 5, 0, 100), 6).alias("percent"),
    )


def clip_range(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    known = cf.known_requests(cf.classify_requests(_pairs(i), _table(i)))
    spread = F.col("user_mean") + (F.col("item_mean") - F.col("user_mean")) * 4
    return known.select(*PAIR, F.round(scalar.clip(spread, 1, 5), 6).alias("clipped"))


def impute_constant(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    joined = _pairs(i).join(i.users(), "user_id", "left").join(
        i.items().select("item_id", "is_open", "latitude", "longitude"), "item_id", "left"
    )
    zero = ("fans", "funny", "compliment_hot", "compliment_note", "is_open")
    return joined.select(
        *PAIR, *[impute(F.col(c), 0).alias(c) for c in zero],
        *[F.round(impute(F.col(c), 0, zero_is_missing=True), 6).alias(c) for c in ("latitude", "longitude")],
    )


def cold_start_class(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    return cf.classify_requests(_pairs(i), _table(i)).select(*PAIR, cf.cold_start_class().alias("cold_class"))


# --- joins -------------------------------------------------------------------


def feat_user_join(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    return _pairs(i).join(features.user_features(sources(i)), "user_id", "left").select(
        *PAIR, _r("average_stars"), "user_review_count", "user_events", _r("date_var", 2)
    )


def feat_item_join(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    return _pairs(i).join(features.item_features(sources(i)), "item_id", "left").select(
        *PAIR, "item_stars", "item_review_count", "item_events",
        F.col("checkin_slots").cast("bigint").alias("checkin_slots"),
        F.col("days_open").cast("bigint").alias("days_open"),
    )


def _known(i: Inputs, table: DataFrame) -> DataFrame:
    return cf.known_requests(cf.classify_requests(_pairs(i), table))


def cf_candidates(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    table = _stored_table(i)
    return cf.candidates(_known(i, table), table).select(
        *PAIR, "neighbor_id", "neighbor_stars", "copies"
    )


def _weights(i: Inputs, opts: cf.CFOptions = cf.CFOptions()) -> DataFrame:
    table = _stored_table(i)
    asked = materialize(cf.classify_requests(_pairs(i), table), "asked")
    return cf.neighbor_weights(asked, table, opts)


def co_rating_counts(spark: SparkSession, sf: str) -> DataFrame:
    weights = _weights(Inputs(spark, sf).store())
    return weights.select("item_id", "neighbor_id", F.col("n").alias("co_raters")).distinct()


def friend_item_mean(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    pairs = materialize(_pairs(i), "asked")
    edges = social.weighted_edges(i.users(), pairs)
    return social.friend_item_mean(pairs, edges, materialize(_reviewed(i), "reviews")).select(
        *PAIR, _r("friend_item_mean"), "n_friend_ratings"
    )


def friend_mean_fallback(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    users = i.users()
    return social.friend_mean_fallback(social.weighted_edges(users, _pairs(i)), users).select(
        "user_id", _r("friend_mean")
    )


# --- aggregations ------------------------------------------------------------


def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.dedupe_last(_events(Inputs(spark, sf)), PAIR, "stars", ORDER)


def global_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _table(Inputs(spark, sf)).agg(
        F.round(F.avg("stars"), 6).alias("global_mean"), F.count(F.lit(1)).alias("n")
    )


def _both_sides(make: Callable[[str, str], DataFrame]) -> DataFrame:
    sides = [
        make(key, other).withColumnRenamed(key, "id").withColumn("side", F.lit(side))
        for side, key, other in (("user", "user_id", "item_id"), ("item", "item_id", "user_id"))
    ]
    return sides[0].unionByName(sides[1])


def group_to_list(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored_table(Inputs(spark, sf).store())
    sides = [
        ratings.group_members(table, key, other).select(
            F.lit(side).alias("side"), F.col(key).alias("id"), F.col(other).alias("member"), "copies"
        )
        for side, key, other in (("user", "user_id", "item_id"), ("item", "item_id", "user_id"))
    ]
    return sides[0].unionByName(sides[1])


def entity_means(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored_table(Inputs(spark, sf).store())
    return _both_sides(lambda key, _: ratings.entity_stats(table, key)).select(
        "side", "id", "events", _r("mean_stars")
    )


def feat_activity_counts(spark: SparkSession, sf: str) -> DataFrame:
    reviews = Inputs(spark, sf).reviews()
    return _both_sides(lambda key, _: ratings.activity_counts(reviews, key)).select("side", "id", "n_events")


def feat_date_variance(spark: SparkSession, sf: str) -> DataFrame:
    return features.user_activity(Inputs(spark, sf).reviews()).select("user_id", _r("date_var", 2))


def _open_items(i: Inputs) -> DataFrame:
    return features.item_profiles(i.items()).filter(F.col("days_open").isNotNull())


def feat_open_time(spark: SparkSession, sf: str) -> DataFrame:
    return _open_items(Inputs(spark, sf)).select("item_id", _r("opening_time"))


def feat_close_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _open_items(Inputs(spark, sf)).select("item_id", "closing_time")


def global_mode(spark: SparkSession, sf: str) -> DataFrame:
    modes = _open_items(Inputs(spark, sf)).filter(F.col("closing_time") != 0)
    return mode.mode_by(modes, (), "closing_time", "closing_mode")


def pcc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    table = _stored_table(i)
    known = materialize(_known(i, table), "asked")
    cand, sums = cf.candidate_sums(known, table)
    asked = cand.filter(cf.may_meet()).select("item_id", "neighbor_id").distinct()
    return (
        cf.with_pair(asked).join(sums, ["lo", "hi"])
        .select("item_id", "neighbor_id", F.col("n").alias("co_raters"), F.round(cf.pearson(), 6).alias("pearson"))
        .filter(F.col("pearson").isNotNull())
    )


def similarity_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(Inputs(spark, sf).store()).select(
        "item_id", "neighbor_id", F.col("n").alias("co_raters"), "rule", _r("w")
    ).distinct()


def topk_neighbors(spark: SparkSession, sf: str, opts: cf.CFOptions = cf.CFOptions()) -> DataFrame:
    best = cf.top_neighbors(_weights(Inputs(spark, sf).store(), opts), opts)
    return best.select(*PAIR, "neighbor_id", _r("w"), "copies")


def cf_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return cf.confidence(_weights(Inputs(spark, sf).store()))


def cf_predict(spark: SparkSession, sf: str, dense: bool = False, opts: cf.CFOptions = cf.CFOptions()) -> DataFrame:
    i = Inputs(spark, sf, dense).store()
    return cf.cf_predict(_pairs(i), _stored_table(i), opts).select(*PAIR, "cf_case", _r("cf"), "trusted")


def _blended(i: Inputs) -> DataFrame:
    table = _stored_table(i)
    asked = cf.classify_requests(_pairs(i), table)
    return asked.select(*PAIR, cf.blended_mean(ratings.global_mean(table)).alias("prediction"))


def blend_means(spark: SparkSession, sf: str) -> DataFrame:
    return _blended(Inputs(spark, sf).store()).select(*PAIR, _r("prediction"))


def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    t = features.feature_tables(sources(i))
    stand_ins = features.constants(t)
    names = ("useful", "cool", "user_avg_stars", "item_avg_stars", "friend_count")
    joined = _pairs(i).join(t.users, "user_id", "left").join(t.items, "item_id", "left")
    rules = {name: features.RULES[name] for name in names}
    return joined.select(*PAIR, *[
        F.round(impute(F.col(r.source), stand_ins[r.default], r.zero_is_missing), 6).alias(name)
        for name, r in rules.items()
    ])


def impute_opening(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    t = features.feature_tables(sources(i))
    rule = features.RULES["opening_time"]
    value = impute(F.col(rule.source), features.constants(t)[rule.default], rule.zero_is_missing)
    asked = _pairs(i).select("item_id").distinct()
    return asked.join(t.items, "item_id", "left").select("item_id", F.round(value, 6).alias("opening_time"))


def _validated(i: Inputs) -> DataFrame:
    """Validation ratings next to predictions from the training period alone."""
    table = materialize(_reviewed(i), "ratings")
    val = materialize(i.val().select(*PAIR, F.col("stars").alias("label")), "validation")
    predicted = cf.cf_predict(val.select(*PAIR).distinct(), table)
    return val.join(predicted, list(PAIR)).select("label", F.col("cf").alias("prediction"))


def eval_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rmse(_validated(Inputs(spark, sf).store())).select("n", _r("rmse"))


def eval_error_hist(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_histogram(_validated(Inputs(spark, sf).store()))


# --- unions, frames, models, blends ------------------------------------------


def union_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return _events(Inputs(spark, sf)).select(*PAIR, "stars", "rated_on")


def _frame(i: Inputs, known: features.Stored | None = None) -> DataFrame:
    known = known or stored_sources(i)
    pairs = materialize(_pairs(i), "asked")
    return features.feature_frame(pairs, known.sources, known.tables, known.reviewed)


def _training(i: Inputs, known: features.Stored | None = None) -> DataFrame:
    known = known or stored_sources(i)
    return features.training_frame(i.val(), known.sources, known.tables, known.reviewed)


def _rounded(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*keep, *[_r(c, 2 if c == "user_date_var" else 6) for c in features.FEATURES])


def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_frame(Inputs(spark, sf).store()), *PAIR)


def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_training(Inputs(spark, sf).store()), *PAIR, "label")


def gbt_predict(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of both full models for every requested pair."""
    i = Inputs(spark, sf).store()
    known = stored_sources(i)
    return models.ensemble_score(pipeline.train_models(known, i.val()), _frame(i, known))


def _model(i: Inputs, b: models.Boosting = QUICK_A) -> tuple[models.Ensemble, DataFrame]:
    known = stored_sources(i)
    training, frame = together(lambda: materialize(_training(i, known), "training"), lambda: materialize(_frame(i, known), "frame"))
    return models.fit(training, b), frame


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a model scores each pair the same before saving and after loading."""
    model, frame = _model(Inputs(spark, sf).store())
    path = fresh_path(spark, "model")
    models.save(model, path)
    both = boosting.score_all([(model, "before", ()), (models.load(spark, path), "after", ())], frame, PAIR)
    return both.select(*PAIR, (F.col("before") == F.col("after")).alias("same"))


def gbt_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each pair's score by joins with the table of nodes is that of the arrays."""
    model, frame = _model(Inputs(spark, sf).store())
    walked = boosting.walk(model, frame, PAIR, "walked")
    both = models.score(model, frame, "scored").select(*PAIR, "scored").join(walked, list(PAIR))
    return both.select(*PAIR, (F.abs(F.col("walked") - F.col("scored")) < 1e-9).alias("same"))


def gbt_error_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Of one fit on the reviews: for the first so many trees, the validation ratings scored, and whether the error is below that of fewer trees."""
    i = Inputs(spark, sf).store()
    at = stored_sources(i)

    def frame(rated: DataFrame, name: str) -> DataFrame:
        return materialize(features.feature_frame(rated, at.sources, at.tables, at.reviewed), name)

    known, held = together(
        lambda: frame(features.labelled_ratings(at.sources.reviews, None), "training"),
        lambda: frame(i.val().select(*PAIR, F.col("stars").alias("label")), "held-out"),
    )
    curve = boosting.error_curve(models.fit(known, QUICK_A), held, (0, TREES // 2, TREES))
    fewer = F.lag("rmse").over(Window.orderBy("trees"))  # a row per number of trees
    return curve.select(
        F.col("trees").cast("long").alias("trees"), F.col("n").cast("long").alias("n"), F.coalesce(F.col("rmse") < fewer, F.lit(True)).alias("falls")
    )


def tune_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Grid points and numbers of trees, and whether each has an error that two folds agree to be possible (0 to 4 stars)."""
    frame = materialize(_training(Inputs(spark, sf).store()), "training")
    errors = models.tune(frame, QUICK_A, {"depth": [2, 4], "learning_rate": [0.05, 0.2]}, trees=(1, 3))
    return errors.select("depth", "learning_rate", "trees", F.col("rmse").between(0, 4).alias("possible"))


def _stand_in(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Collaborative predictions, and the mean of user and item means in place of model scores."""
    table = _stored_table(i)
    pairs = materialize(_pairs(i), "asked")
    mean = ratings.global_mean(table)
    scores = cf.classify_requests(pairs, table).select(
        *PAIR,
        models.ensemble_mean(F.coalesce("user_mean", mean), F.coalesce("item_mean", mean)).alias("model_score"),
    )
    return cf.cf_predict(pairs, table), scores


def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf).store()
    table = _stored_table(i)
    mean = ratings.global_mean(table)
    both = models.ensemble_mean(F.coalesce("user_mean", mean), F.coalesce("item_mean", mean))
    return cf.classify_requests(_pairs(i), table).select(*PAIR, F.round(both, 6).alias("model_score"))


def hybrid_blend(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.hybrid_blend(*_stand_in(Inputs(spark, sf).store())).select(*PAIR, _r("prediction"))


def hybrid_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the blend on the validation ratings, from the training period alone; means stand for model scores."""
    i = Inputs(spark, sf).store()
    table = materialize(_reviewed(i), "ratings")
    val = materialize(i.val().select(*PAIR, F.col("stars").alias("label")), "validation")
    pairs = materialize(val.select(*PAIR).distinct(), "asked")
    mean = ratings.global_mean(table)
    scores = cf.classify_requests(pairs, table).select(
        *PAIR,
        models.ensemble_mean(F.coalesce("user_mean", mean), F.coalesce("item_mean", mean)).alias("model_score"),
    )
    blended = hybrid.hybrid_blend(cf.cf_predict(pairs, table), scores)
    return evaluate.rmse(val.join(blended, list(PAIR))).select("n", _r("rmse"))


def hybrid_model_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The blend with fitted models on the validation ratings, from the training period alone: rows, and whether it beats the models' base score."""
    i = Inputs(spark, sf).store()
    s = stored_sources(i)
    fitted = pipeline.train_models(s, None, (QUICK_A, QUICK_B))
    val = materialize(i.val().select(*PAIR, F.col("stars").alias("label")), "validation")
    asked = val.select(*PAIR).distinct()
    blended = pipeline.predict(asked, [i.train()], ORDER, s, fitted)
    error = evaluate.rmse(val.join(blended, list(PAIR)))
    base = F.sqrt(F.avg((F.col("label") - models.MODEL_A.base_score) ** 2))
    return error.select("n", (F.col("rmse") < val.agg(base).scalar()).alias("beats_base"))


def hybrid_predict(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: fit both full models, then predict every requested row."""
    i = Inputs(spark, sf).store()
    known = stored_sources(i)
    return pipeline.predict(
        i.requests(), [i.train(), i.val()], ORDER, known, pipeline.train_models(known, i.val())
    )


def queries() -> dict[str, Query]:
    plain = [
        scan_ratings, scan_bad_ratings, scan_users_last, scan_requests, scan_json_items, scan_lookup_map, sink_predictions_csv,
        filter_present_map, row_range_slice, friend_edges, feat_friend_count, feat_days_open,
        feat_checkin_slots, feat_binary_attr, feat_onehot_attr, feat_price_range, feat_member_since,
        feat_hours_parse, dict_encode, feat_interactions, linear_interp, clip_range, impute_constant,
        cold_start_class, feat_user_join, feat_item_join, cf_candidates, co_rating_counts,
        friend_item_mean, friend_mean_fallback, dedupe_last, global_mean, group_to_list, entity_means,
        feat_activity_counts, feat_date_variance, feat_open_time, feat_close_mode, global_mode,
        pcc_pairs, similarity_ladder, topk_neighbors, cf_confidence, cf_predict, blend_means,
        impute_mean, impute_opening, eval_rmse, eval_error_hist, union_ratings, feature_frame,
        training_frame, gbt_predict, model_roundtrip, gbt_walk, gbt_error_curve, tune_gbt, ensemble_mean, hybrid_blend,
        hybrid_predict, hybrid_eval, hybrid_model_eval,
    ]
    out: dict[str, Query] = {fn.__name__: fn for fn in plain}
    out["topk_neighbors_signed"] = partial(topk_neighbors, opts=cf.CFOptions(order="signed"))
    out["topk_neighbors_abs"] = partial(topk_neighbors, opts=cf.CFOptions(order="abs"))
    # a limit that deals most users' candidates over splits
    out["topk_neighbors_heavy"] = partial(topk_neighbors, opts=DEALT)
    out["cf_predict_heavy"] = partial(cf_predict, opts=DEALT)
    out["cf_predict_dense"] = partial(cf_predict, dense=True)
    return out
