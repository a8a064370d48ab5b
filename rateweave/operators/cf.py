"""Item-based collaborative filtering.

The weight of a neighbour item depends on the item pair alone, so it is worked out once
per pair from six sums over the users who rated both, never from lists of users.
Only the item pairs that requests need are summed. Where the work could pile up, it is bounded or dealt out:

* An item that at most ``LISTED_RATERS`` users rated carries short marks of them all. Where two such lists share no mark, nobody rated both items: the
  candidate has its weight where it is made and is not moved. Where they do, only the ratings behind shared marks are looked up, and a rating counts
  only if the same user gave both. All other pairs are summed as follows, so that the lists decide what is moved and not what is found.
* A co-rating is a triangle of a user and the two items of a needed pair. Each pair is looked up from one side only, that of the item
  in fewer pairs, so that of E pairs no item has more than sqrt(2E) to look up. A rating then expands to the smaller of two sets: the item's partners
  to look up, each of which is probed for a rating of the user, or the user's items, each of which is probed for a needed pair. No user's
  items are paired with each other beyond that, however many they are.
* A user's requests meet the user's items under several keys, so that a key makes about ``pairs_per_split``
  candidates at most, whether the requests or the items are many.

There is one plan for all data: parts without rows cost nothing. ``CFOptions`` moves the limits, not the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rateweave.functions.scalar import amplify, clip, reflect_rating
from rateweave.operators.ratings import PAIR, RATING_UNITS, entity_stats, global_mean, units
from rateweave.session import materialize

# Neighbour weights used where a correlation is not computed.
NO_CO_RATERS = 0.65
ONE_BOTH_ABOVE = 0.75
ONE_BOTH_BELOW = 0.80
ONE_MIXED = 0.35
TWO_OR_THREE = 0.65
NO_VARIANCE = 0.70
NO_COVARIANCE = 0.95
FIXED_WEIGHTS = tuple(sorted({
    NO_CO_RATERS, ONE_BOTH_ABOVE, ONE_BOTH_BELOW, ONE_MIXED, TWO_OR_THREE, NO_VARIANCE, NO_COVARIANCE,
}))
# Neighbours per prediction and correlations needed to trust it.
NEIGHBORS = 20
TRUSTED_WEIGHTS = 2
#: Words of 64 bits that mark the partners of an item.
MARK_WORDS = 16
#: Items with more raters have no list of them.
LISTED_RATERS = 64
#: Needed pairs whose co-ratings are met at once, and the rounds that this takes at most: a round's co-ratings are gone from disk before the next one's are moved.
PAIRS_PER_ROUND = 1_000_000
MOST_ROUNDS = 2


@dataclass(frozen=True)
class CFOptions:
    neighbors: int = NEIGHBORS
    order: str = "weight"
    exclude_target: bool = False
    pairs_per_split: int = 1_000_000


def classify_requests(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Requested pairs with the means and event counts of user and item, null where unknown."""
    users = entity_stats(table, "user_id").select(
        "user_id", F.col("events").alias("user_events"), F.col("mean_stars").alias("user_mean"),
        F.col("partners").alias("user_items"),
    )
    items = entity_stats(table, "item_id").select(
        "item_id", F.col("events").alias("item_events"), F.col("mean_stars").alias("item_mean")
    )
    return pairs.join(users, "user_id", "left").join(items, "item_id", "left")


def cold_start_class() -> Column:
    """Which sides of a classified request are unknown."""
    no_user, no_item = F.col("user_events").isNull(), F.col("item_events").isNull()
    return (
        F.when(no_user & no_item, "unknown_both")
        .when(no_user, "unknown_user")
        .when(no_item, "unknown_item")
        .otherwise("known")
    )


def rater_mark() -> Column:
    """16 bits of a user's hash: the same for the same user, seldom for two raters of two items."""
    return (F.pmod(F.xxhash64("user_id"), F.lit(1 << 16)) - (1 << 15)).cast("short")


def rater_lists(table: DataFrame, means: bool = False) -> DataFrame:
    """``item_id, raters`` with the marks of all raters, null where these are too many to list; with ``means`` the item's ``mean_stars`` too."""
    stats = materialize(entity_stats(table, "item_id").select("item_id", "partners", *(["mean_stars"] if means else [])), "item-stats")
    few = stats.filter(F.col("partners") <= LISTED_RATERS).select("item_id")
    lists = table.select("item_id", rater_mark().alias("mark")).join(few, "item_id").groupBy("item_id").agg(F.collect_list("mark").alias("raters"))
    return materialize(stats.drop("partners").join(lists, "item_id", "left"), "rater-lists")


def candidates(known: DataFrame, table: DataFrame, opts: CFOptions = CFOptions(), lists: DataFrame | None = None) -> DataFrame:
    """Every item the requesting user rated, per request: ``user, item, neighbor, rating, copies``.

    The items of a user with many requests, items or both are dealt over several splits, and the user's requests go to each.
    With ``lists`` of raters there is ``shared`` too, the marks that both items' raters have, null if not both are listed, and ``neighbor_mean`` if
    the lists have means.
    """
    pairs = F.count(F.lit(1)) * F.first("user_items")
    splits = F.least(F.ceil(pairs / opts.pairs_per_split), F.first("user_items")).cast("int")
    asking = known.groupBy("user_id").agg(splits.alias("_splits"))
    probe = known.join(asking, "user_id").select(*PAIR, F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)).alias("_split"))
    rated = table.join(asking, "user_id").select(
        "user_id", F.col("item_id").alias("neighbor_id"), F.col("stars").alias("neighbor_stars"), "copies",
        F.pmod(F.hash("item_id"), F.col("_splits")).alias("_split"),
    )
    if lists is not None:
        probe = probe.join(lists.select("item_id", F.col("raters").alias("_item_raters")), "item_id")
        renamed = {"item_id": "neighbor_id", "raters": "_neighbor_raters", "mean_stars": "neighbor_mean"}
        rated = rated.join(lists.select(*(F.col(c).alias(renamed[c]) for c in lists.columns)), "neighbor_id")
    out = probe.join(rated, ["user_id", "_split"]).drop("_split")
    if lists is not None:
        out = out.withColumn("shared", F.array_intersect("_item_raters", "_neighbor_raters")).drop("_item_raters", "_neighbor_raters")
    return out.filter(F.col("item_id") != F.col("neighbor_id")) if opts.exclude_target else out


def may_meet() -> Column:
    """Whether a candidate's two items may have a rater in common."""
    return F.col("shared").isNull() | (F.size("shared") > 0)


def with_pair(cand: DataFrame) -> DataFrame:
    return cand.withColumn("lo", F.least("item_id", "neighbor_id")).withColumn(
        "hi", F.greatest("item_id", "neighbor_id")
    )


def needed_pairs(cand: DataFrame) -> DataFrame:
    """The distinct item pairs ``lo <= hi`` of candidates."""
    return with_pair(cand).select("lo", "hi").distinct()


def oriented(pairs: DataFrame) -> DataFrame:
    """``near, far`` of each pair, written once: ``near`` is the item in fewer pairs, of two equal ones the smaller id.

    The pairs, which several branches read, are written too: working them out takes all candidates.
    """
    pairs = materialize(pairs, "needed-pairs")
    sides = [pairs.groupBy(F.col(side).alias("item")).agg(F.count(F.lit(1)).alias("pairs")) for side in ("lo", "hi")]
    degree = sides[0].unionByName(sides[1]).groupBy("item").agg(F.sum("pairs").alias("pairs"))
    both = pairs.join(degree.toDF("lo", "lo_pairs"), "lo").join(degree.toDF("hi", "hi_pairs"), "hi")
    straight = F.col("lo_pairs") <= F.col("hi_pairs")
    return materialize(both.select(
        F.when(straight, F.col("lo")).otherwise(F.col("hi")).alias("near"), F.when(straight, F.col("hi")).otherwise(F.col("lo")).alias("far"),
    ), "oriented-pairs")


def mark(item: str) -> tuple[Column, Column]:
    """Word and bit of an item in ``marks``."""
    place = F.pmod(F.xxhash64(item), F.lit(MARK_WORDS * 64))
    return F.floor(place / 64).cast("int"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({item}), 64) AS INT))")


def ratings_to_expand(table: DataFrame, edges: DataFrame) -> DataFrame:
    """The ratings of items in any pair: ``user_id, item_id, stars, pairs, partners, marks, user_items``.

    ``pairs`` of the item, of which ``partners`` are to be looked up from it, and how many such items the user has rated. ``marks`` has
    a bit set for each partner, ``MARK_WORDS`` * 64 bits in all: it tells most items that are no partners before they are moved.
    """
    word, bit = mark("far")
    marks = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(MARK_WORDS)]
    # The edges are dealt by item before marks are made: marks of one item from many tasks would be many times larger than the edges.
    near = edges.repartition("near").groupBy(F.col("near").alias("item_id")).agg(F.count(F.lit(1)).alias("partners"), F.array(*marks).alias("marks"))
    far = edges.groupBy(F.col("far").alias("item_id")).agg(F.count(F.lit(1)).alias("others"))
    items = materialize(near.join(far, "item_id", "full").select(
        "item_id", (F.coalesce("partners", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("pairs"),
        F.coalesce("partners", F.lit(0)).alias("partners"), "marks",
    ), "items")
    rated = table.join(items, "item_id").select("user_id", "item_id", units(F.col("stars")).alias("stars"), "pairs", "partners", "marks")
    return rated.join(rated.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_items")), "user_id")


def expanded(rated: DataFrame, edges: DataFrame, mine: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``user_id, near, far, x`` to be probed for the user's rating of ``far``, and rows with that rating ``y`` to be probed for the pair.

    Together at most the sum over all ratings of the smaller of ``partners`` and ``user_items``. With a condition ``mine`` on ``near``, those of such items.
    """
    by_partners = F.col("partners") <= F.col("user_items")
    near = rated.filter("partners > 0").select(
        "user_id", F.col("item_id").alias("near"), F.col("stars").alias("x"), "pairs", "marks", by_partners.alias("by_partners")
    )
    near, edges = (near, edges) if mine is None else (near.filter(mine), edges.filter(mine))
    to_rate = near.filter("by_partners").join(edges, "near").select("user_id", "near", "far", "x")
    others = rated.select("user_id", F.col("item_id").alias("far"), F.col("stars").alias("y"), F.col("pairs").alias("far_pairs"))
    # only partners that come after the item in the order of looking up
    after = (F.col("pairs") < F.col("far_pairs")) | ((F.col("pairs") == F.col("far_pairs")) & (F.col("near") <= F.col("far")))
    word, bit = mark("far")
    marked = F.get("marks", word).bitwiseAND(bit) != 0
    to_pair = near.filter("not by_partners").join(others, "user_id").filter(after & marked).select("user_id", "near", "far", "x", "y")
    return to_rate, to_pair


def listed_pairs(cand: DataFrame) -> DataFrame:
    """``lo, hi, mark`` of candidates with ``shared`` marks, one row per mark, written once."""
    marks = with_pair(cand.filter(F.size("shared") > 0)).select("lo", "hi", F.explode("shared").alias("mark"))
    return materialize(marks.distinct(), "shared-marks")


def listed_co_ratings(table: DataFrame, marks: DataFrame) -> DataFrame:
    """``lo, hi, x, y`` for each pair with shared ``marks`` and each user behind a mark who rated both."""
    stars = units(F.col("stars"))
    first = table.select("user_id", F.col("item_id").alias("lo"), rater_mark().alias("mark"), stars.alias("x"))
    second = table.select("user_id", F.col("item_id").alias("hi"), stars.alias("y"))
    return marks.join(first, ["lo", "mark"]).select("user_id", "lo", "hi", "x").join(second, ["user_id", "hi"]).select("lo", "hi", "x", "y")


def co_ratings(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lo, hi, x, y`` for each needed pair and each user who rated both."""
    edges = oriented(pairs)
    return met(ratings_to_expand(table, edges), edges)


def met(rated: DataFrame, edges: DataFrame, mine: Column | None = None) -> DataFrame:
    """The same from ratings to expand and directed pairs, of all or of those with a ``near`` that meets a condition."""
    to_rate, to_pair = expanded(rated, edges, mine)
    second = rated.select("user_id", F.col("item_id").alias("far"), F.col("stars").alias("y"))
    found = to_rate.join(second, ["user_id", "far"]).select("near", "far", "x", "y").unionByName(
        to_pair.join(edges, ["near", "far"], "left_semi").select("near", "far", "x", "y")
    )
    straight = F.col("near") <= F.col("far")
    return found.select(
        F.least("near", "far").alias("lo"), F.greatest("near", "far").alias("hi"),
        F.when(straight, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(straight, F.col("y")).otherwise(F.col("x")).alias("y"),
    )


def pair_sums(table: DataFrame, pairs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``lo, hi, n, sx, sy, cov, var_x, var_y`` over the co-raters of each of the needed ``pairs`` (lo <= hi, distinct) that has any.

    The same for further pairs, given with the ``marks`` that their raters share. Many pairs are met in rounds by ``near``, which each pair has one of. Sums
    are written once: what was moved for them is gone from disk when they are read.
    """
    x, y = F.col("x"), F.col("y")
    edges = oriented(pairs)
    rated = ratings_to_expand(table, edges)
    rounds = max(1, min(MOST_ROUNDS, -(-edges.count() // PAIRS_PER_ROUND)))
    parts = []
    for turn in range(rounds):
        found = met(rated, edges, F.pmod(F.xxhash64("near"), F.lit(rounds)) == turn if rounds > 1 else None)
        if marks is not None and not turn:
            found = found.unionByName(listed_co_ratings(table, marks))
        parts.append(materialize(with_spread(found.groupBy("lo", "hi").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
            F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        )), "pair-sums"))
    return reduce(DataFrame.unionByName, parts)


def with_spread(sums: DataFrame) -> DataFrame:
    """Sums in stars, with n * sum(xy) - sum(x) * sum(y) and its likes in squared stars, from whole rating units, so that zeros are exact.

    For whole stars these are whole numbers, as if the units had never been, so correlations that tie by definition tie here too.
    """
    n, sx, sy, sxy, sxx, syy = (F.col(c).cast("decimal(19,0)") for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    spread = {"cov": n * sxy - sx * sy, "var_x": n * sxx - sx * sx, "var_y": n * syy - sy * sy}
    kept = [c for c in sums.columns if c not in ("sx", "sy", "sxy", "sxx", "syy")]
    return sums.select(
        *kept, *((F.col(c) / RATING_UNITS).alias(c) for c in ("sx", "sy")), *((v.cast("double") / RATING_UNITS**2).alias(c) for c, v in spread.items())
    )


def pearson() -> Column:
    """Correlation from the spreads, clipped to [-1, 1]; null where a side does not vary."""
    cov, var_x, var_y = F.col("cov"), F.col("var_x"), F.col("var_y")
    return clip(F.when((var_x > 0) & (var_y > 0), cov / (F.sqrt(var_x) * F.sqrt(var_y))), -1, 1)


def similarity_case(mean: Column) -> Column:
    """Which rule gives the weight; ``mean`` is the global mean rating."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "no_co_raters")
        .when((n == 1) & (sx > mean) & (sy > mean), "one_both_above")
        .when((n == 1) & (sx < mean) & (sy < mean), "one_both_below")
        .when(n == 1, "one_mixed")
        .when(n <= 3, "two_or_three")
        .when((F.col("var_x") <= 0) | (F.col("var_y") <= 0), "no_variance")
        .when(F.col("cov") == 0, "no_covariance")
        .otherwise("pearson")
    )


def similarity_weight(case: Column) -> Column:
    return (
        F.when(case == "no_co_raters", NO_CO_RATERS)
        .when(case == "one_both_above", ONE_BOTH_ABOVE)
        .when(case == "one_both_below", ONE_BOTH_BELOW)
        .when(case == "one_mixed", ONE_MIXED)
        .when(case == "two_or_three", TWO_OR_THREE)
        .when(case == "no_variance", NO_VARIANCE)
        .when(case == "no_covariance", NO_COVARIANCE)
        .otherwise(pearson())
    )


def weigh(cand: DataFrame, sums: DataFrame, mean: Column) -> DataFrame:
    """Candidates with ``n``, ``rule`` and weight ``w``."""
    # The keys are expressions, so that candidates don't carry them as columns too.
    met = (F.least("item_id", "neighbor_id") == F.col("lo")) & (F.greatest("item_id", "neighbor_id") == F.col("hi"))
    joined = cand.join(sums, met, "left")
    return joined.withColumn("rule", similarity_case(mean)).select(
        *_kept(cand), F.coalesce("n", F.lit(0)).alias("n"), "rule", similarity_weight(F.col("rule")).alias("w"),
    )


def weigh_apart(cand: DataFrame) -> DataFrame:
    """The same for candidates whose items have no rater in common."""
    return cand.select(
        *_kept(cand), F.lit(0).cast("long").alias("n"), F.lit("no_co_raters").alias("rule"), F.lit(NO_CO_RATERS).alias("w"),
    )


def _kept(cand: DataFrame) -> list[str]:
    return [*PAIR, "neighbor_id", "neighbor_stars", "copies", *(c for c in cand.columns if c == "neighbor_mean")]


def _neighbor_order(order: str) -> list[Column]:
    w, tie = F.col("w"), F.col("neighbor_id").asc()
    if order == "weight":
        return [w.desc(), tie]
    if order == "abs":
        return [F.abs(w).desc(), tie]
    if order == "signed":
        return [(w > 0).desc(), F.when(w > 0, -w).otherwise(w).asc(), tie]
    raise ValueError(f"unknown neighbour order {order!r}")


def top_neighbors(weights: DataFrame, opts: CFOptions = CFOptions()) -> DataFrame:
    """The best ``neighbors`` events per request, with how many copies of each made the cut.

    An item rated m times counts m times. The rank filter is applied before the shuffle,
    so a request with very many candidates moves no more than its best ones.
    """
    # Both columns come from one sort; a frame up to the row itself lets the rank filter be applied early.
    by_rank = Window.partitionBy(*PAIR).orderBy(*_neighbor_order(opts.order))
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = weights.select("*", F.row_number().over(by_rank).alias("rank"), F.sum("copies").over(so_far).alias("_so_far"))
    best = ranked.filter(F.col("rank") <= opts.neighbors)
    room = F.lit(opts.neighbors) - (F.col("_so_far") - F.col("copies"))
    return best.withColumn("copies", F.least("copies", room)).drop("_so_far").filter(F.col("copies") > 0)


def confidence(weights: DataFrame) -> DataFrame:
    """Per request: number of computed correlations and whether there are enough of these."""
    computed = F.sum(F.when(F.col("w").isin(*FIXED_WEIGHTS), F.lit(0)).otherwise(F.col("copies")))
    return weights.groupBy(*PAIR).agg(computed.alias("n_computed")).withColumn(
        "trusted", F.col("n_computed") >= TRUSTED_WEIGHTS
    )


def amplified_sums(best: DataFrame, table: DataFrame) -> DataFrame:
    """Per request: amplified weighted deviations of the neighbours and the sum of amplified weights.

    Neighbours that come with ``neighbor_mean`` are not moved for it.
    """
    if "neighbor_mean" not in best.columns:
        means = entity_stats(table, "item_id").select(F.col("item_id").alias("neighbor_id"), F.col("mean_stars").alias("neighbor_mean"))
        best = best.join(means, "neighbor_id")
    w = F.col("w")
    deviation = reflect_rating(F.col("neighbor_stars"), w) - F.col("neighbor_mean")
    return best.groupBy(*PAIR).agg(
        F.sum(deviation * amplify(w) * F.col("copies")).alias("num"),
        F.sum(amplify(w) * F.col("copies")).alias("den"),
    )


def blended_mean(mean: Column) -> Column:
    """User and item mean weighted by their events; the known one alone; else the global mean."""
    un, um, n, m = (F.col(c) for c in ("user_events", "user_mean", "item_events", "item_mean"))
    both = (m * n + um * un) / (n + un)
    return F.coalesce(both, um, m, mean)


def known_requests(asked: DataFrame) -> DataFrame:
    return asked.filter(F.col("user_events").isNotNull() & F.col("item_events").isNotNull())


def candidate_sums(known: DataFrame, table: DataFrame, opts: CFOptions = CFOptions(), means: bool = False) -> tuple[DataFrame, DataFrame]:
    """The candidates of known requests with ``shared`` marks, written once, and the sums of their item pairs."""
    cand = materialize(candidates(known, table, opts, rater_lists(table, means)), "candidates")
    return cand, pair_sums(table, needed_pairs(cand.filter(F.col("shared").isNull())), listed_pairs(cand))


def neighbor_weights(asked: DataFrame, table: DataFrame, opts: CFOptions = CFOptions(), means: bool = False) -> DataFrame:
    """Every candidate of the classified requests with its weight, and the ``neighbor_mean`` if asked for. All of it is written once."""
    cand, sums = candidate_sums(known_requests(asked), table, opts, means)
    met = materialize(weigh(cand.filter(may_meet()), sums, global_mean(table)), "weights")
    return weigh_apart(cand.filter(~may_meet())).unionByName(met)


def cf_predict(pairs: DataFrame, table: DataFrame, opts: CFOptions = CFOptions()) -> DataFrame:
    """One row ``user, item, cf_case, cf, trusted`` per requested pair (which must be distinct).

    ``table`` is a rating table, best a materialized one. The classified requests and the
    candidate weights are written once too, since several branches of the plan read them.
    """
    asked = materialize(classify_requests(pairs, table), "requests")
    weights = neighbor_weights(asked, table, opts, means=True)
    return score_requests(asked, weights, table, opts)


def score_requests(
    asked: DataFrame, weights: DataFrame, table: DataFrame, opts: CFOptions = CFOptions()
) -> DataFrame:
    """Predictions from classified requests and weighted candidates."""
    mean = global_mean(table)
    sums = amplified_sums(top_neighbors(weights, opts), table)
    trust = confidence(weights).select(*PAIR, "trusted")
    cold = cold_start_class()
    case = (
        F.when(cold != "known", cold)
        .when(F.col("den").isNull(), "no_neighbors")
        .when(F.col("den") == 0, "zero_weights")
        .otherwise("neighbors")
    )
    value = (
        F.when(F.col("cf_case") == "unknown_both", mean)
        .when(F.col("cf_case") == "unknown_user", F.col("item_mean"))
        .when(F.col("cf_case").isin("unknown_item", "no_neighbors"), F.col("user_mean"))
        .when(F.col("cf_case") == "zero_weights", blended_mean(mean))
        .otherwise(F.try_divide("num", "den") + F.col("item_mean"))
    )
    return (
        asked.join(sums.join(trust, list(PAIR)), list(PAIR), "left")
        .withColumn("cf_case", case)
        .select(
            *PAIR, "cf_case", clip(value, 1, 5).alias("cf"),
            ((F.col("cf_case") == "neighbors") & F.col("trusted")).alias("trusted"),
        )
    )
