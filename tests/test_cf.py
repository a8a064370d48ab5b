import random

import pytest
from pyspark.sql import functions as F

from rateweave.operators import cf
from rateweave.operators.ratings import expand_copies, fold_requests, group_members, rating_table, row_range
from tests import brute


def _events(spark, rows):
    numbered = [(u, i, float(s), k) for k, (u, i, s) in enumerate(rows)]
    return spark.createDataFrame(numbered, "user_id long, item_id long, stars double, ord int")


def _predict(spark, rows, requests, opts):
    table = rating_table(_events(spark, rows), ["ord"])
    pairs = spark.createDataFrame(list(set(requests)), "user_id long, item_id long")
    got = cf.cf_predict(pairs, table, opts).collect()
    assert len(got) == len(set(requests))
    return {(r.user_id, r.item_id): (r.cf_case, r.cf, r.trusted) for r in got}


def _random_case(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), rng.randrange(40), rng.randint(1, 5)) for _ in range(260)]
    # One user holds about a third of all events, another rated many items none of which others know.
    rows += [(99, i, rng.randint(1, 5)) for i in range(45) for _ in range(2)]
    rows += [(98, 100 + i, rng.randint(1, 5)) for i in range(60)]
    rng.shuffle(rows)
    requests = [(rng.randrange(27), rng.randrange(43)) for _ in range(60)]
    requests += [(98, i) for i in range(42)] + [(99, i) for i in (3, 50, 101)] + [(98, 105)]
    return rows, requests


SPLITS = [
    cf.CFOptions(),
    cf.CFOptions(pairs_per_split=7),
    cf.CFOptions(pairs_per_split=50, neighbors=4),
    cf.CFOptions(pairs_per_split=1, neighbors=6),
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("opts", SPLITS)
def test_predictions_match_definition(spark, seed, opts):
    rows, requests = _random_case(seed)
    want = brute.predict(rows, requests, opts.neighbors)
    got = _predict(spark, rows, requests, opts)
    assert got.keys() == want.keys()
    for pair, (case, value, trusted) in want.items():
        assert got[pair][0] == case, pair
        assert got[pair][1] == pytest.approx(value, abs=1e-9), pair
        assert got[pair][2] == trusted, pair


@pytest.mark.parametrize("opts", [cf.CFOptions(), cf.CFOptions(pairs_per_split=10)])
def test_heavy_user_keeps_all_neighbors(spark, opts):
    rows = [(1, i, 3) for i in range(500)] + [(2, 1000, 4), (2, 7, 5), (3, 1000, 2)]
    table = rating_table(_events(spark, rows), ["ord"])
    pairs = spark.createDataFrame([(1, 1000)], "user_id long, item_id long")
    asked = cf.classify_requests(pairs, table)
    weights = cf.neighbor_weights(asked, table, opts)
    assert weights.count() == 500
    best = {r.neighbor_id for r in cf.top_neighbors(weights, opts).collect()}
    assert len(best) == 20 and len(best & set(range(22))) == 20


def test_only_needed_pairs_are_summed(spark):
    rows, requests = _random_case(3)
    table = rating_table(_events(spark, rows), ["ord"])
    pairs = spark.createDataFrame(list(set(requests)), "user_id long, item_id long")
    cand = cf.candidates(cf.known_requests(cf.classify_requests(pairs, table)), table)
    needed = {(r.lo, r.hi) for r in cf.needed_pairs(cand).collect()}
    summed = {(r.lo, r.hi) for r in cf.pair_sums(table, cf.needed_pairs(cand)).collect()}
    assert summed and summed <= needed
    assert needed == {(min(r.item_id, r.neighbor_id), max(r.item_id, r.neighbor_id)) for r in cand.collect()}


def test_lookups_are_bounded(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(80), int(200 * rng.random() ** 3), rng.randint(1, 5)) for _ in range(4000)]
    rows += [(500, i, 3) for i in range(200)] + [(u, 0, 4) for u in range(600, 900)]  # an item that many rated, a user who rated all
    table = rating_table(_events(spark, rows), ["ord"])
    pairs = spark.createDataFrame([(500, i) for i in range(0, 200, 3)] + [(k, k) for k in range(40)], "user_id long, item_id long")
    cand = cf.candidates(cf.known_requests(cf.classify_requests(pairs, table)), table)
    edges = cf.oriented(cf.needed_pairs(cand))
    rated = cf.ratings_to_expand(table, edges)
    to_rate, to_pair = cf.expanded(rated, edges)
    made = to_rate.count() + to_pair.count()
    assert to_rate.count() > 0 and to_pair.count() > 0
    assert made <= rated.agg(F.sum(F.least("partners", "user_items"))).first()[0]
    n_edges = edges.count()
    assert edges.groupBy("near").count().agg(F.max("count")).first()[0] <= (2 * n_edges) ** 0.5 + 1
    items_of = {}
    for u, i in {(u, i) for u, i, _ in rows}:
        items_of.setdefault(u, set()).add(i)
    needed = {(r.near, r.far) for r in edges.collect()}
    brute_force = sum((a in its) and (b in its) for its in items_of.values() for a, b in needed)
    assert cf.co_ratings(table, cf.needed_pairs(cand)).count() == brute_force


def test_needed_pairs_are_worked_out_once_and_marks_where_edges_meet(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(cf, "materialize", lambda df, name: written.setdefault(name, df))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "lo long, hi long")
    table = rating_table(_events(spark, [(u, i, 3) for u in range(4) for i in (1, 2, 3, 4)]), ["ord"])
    rated = cf.ratings_to_expand(table, cf.oriented(pairs)).select("item_id", "pairs", "partners").distinct()
    assert sorted(written) == ["items", "needed-pairs", "oriented-pairs"]
    assert {r.item_id: (r.pairs, r.partners) for r in rated.collect()} == {1: (2, 1), 2: (2, 0), 3: (1, 1), 4: (1, 1)}
    assert "RepartitionByExpression [near" in written["items"]._jdf.queryExecution().optimizedPlan().toString()


def _known(spark, rows, requests):
    table = rating_table(_events(spark, rows), ["ord"])
    pairs = spark.createDataFrame(sorted(set(requests)), "user_id long, item_id long")
    return table, cf.classify_requests(pairs, table)


def test_pairs_without_co_raters_are_not_moved(spark, monkeypatch):
    # user 1 rated 30 items that nobody else did, one of them with user 2, who rated the requested item
    rows = [(1, i, 3) for i in range(30)] + [(2, 7, 4), (2, 100, 5), (3, 100, 2)]
    table, asked = _known(spark, rows, [(1, 100)])
    written, write = {}, cf.materialize
    monkeypatch.setattr(cf, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    weights = cf.neighbor_weights(asked, table)
    assert written["needed-pairs"].count() == 0 and written["weights"].count() == 1
    assert [(r.lo, r.hi) for r in written["shared-marks"].collect()] == [(7, 100)]
    assert sorted((r.neighbor_id, r.n) for r in weights.collect()) == [(i, int(i == 7)) for i in range(30)]


@pytest.mark.parametrize("listed, bits", [(64, 15), (12, 15), (12, 3), (0, 15)])
def test_lists_of_raters_change_no_sum(spark, monkeypatch, listed, bits):
    rows, requests = _random_case(6)
    table, asked = _known(spark, rows, requests)
    monkeypatch.setattr(cf, "LISTED_RATERS", listed)  # items with more raters are looked up
    monkeypatch.setattr(cf, "rater_mark", lambda: F.pmod(F.xxhash64("user_id"), F.lit(1 << bits)).cast("short"))  # so that users share marks
    items_of, last = {}, {}
    for u, i, s in rows:
        items_of.setdefault(i, set()).add(u)
        last[u, i] = s
    weights = cf.neighbor_weights(asked, table).collect()
    known = [(u, i) for u, i in set(requests) if i in items_of and any((u, j) in last for j in items_of)]
    assert sorted((r.user_id, r.item_id, r.neighbor_id) for r in weights) == sorted((u, i, j) for u, i in known for j in items_of if (u, j) in last)
    assert all(r.n == len(items_of[r.item_id] & items_of[r.neighbor_id]) for r in weights)
    assert {r.rule for r in weights} >= {"no_co_raters", "pearson"}


def test_neighbours_with_means_are_not_moved_for_them(spark):
    table, asked = _known(spark, *_random_case(7))
    weights = cf.neighbor_weights(asked, table, means=True)
    plain = cf.amplified_sums(cf.top_neighbors(weights.drop("neighbor_mean")), table)
    carried = cf.amplified_sums(cf.top_neighbors(weights), table)
    assert "Join" in plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in carried._jdf.queryExecution().optimizedPlan().toString()
    rounded = [sorted((r.user_id, r.item_id, round(r.num, 9), round(r.den, 9)) for r in df.collect()) for df in (plain, carried)]
    assert rounded[0] == rounded[1] and rounded[0]


def test_sums_of_tenths_are_exact(spark):
    # 0.1 + 0.2 and the like: neither side varies, or the sides don't vary together
    flat = [(u, i, 3.3) for u in range(7) for i in (1, 2)]
    crossed = [(u, 3, s) for u, s in zip(range(10, 14), (1.1, 1.1, 4.7, 4.7))] + [(u, 4, s) for u, s in zip(range(10, 14), (1.3, 4.9, 1.3, 4.9))]
    table = rating_table(_events(spark, flat + crossed), ["ord"])
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "lo long, hi long")
    for parts in (1, 3):
        got = cf.pair_sums(table.repartition(parts), pairs).withColumn("rule", cf.similarity_case(F.lit(3.0))).collect()
        assert {r.lo: r.rule for r in got} == {1: "no_variance", 3: "no_covariance"}


def test_correlations_of_whole_stars_have_no_trace_of_the_units(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(400):
        both = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(rng.randint(4, 9))]
        n, sx, sy = len(both), sum(x for x, _ in both), sum(y for _, y in both)
        sxy, sxx, syy = sum(x * y for x, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both)
        rows.append((k, n, 1000 * sx, 1000 * sy, 10**6 * sxy, 10**6 * sxx, 10**6 * syy))
        var_x, var_y = n * sxx - sx * sx, n * syy - sy * sy
        want[k] = max(-1.0, min(1.0, (n * sxy - sx * sy) / (var_x**0.5 * var_y**0.5))) if var_x and var_y else None
    df = cf.with_spread(spark.createDataFrame(rows, "k int, n long, sx long, sy long, sxy long, sxx long, syy long"))
    assert {r.k: r.r for r in df.select("k", cf.pearson().alias("r")).collect()} == want  # to the last bit


def _ladder(spark, pairs_of_ratings, mean=3.0):
    """Rule and weight for two items given each co-rater's pair of ratings."""
    rows = []
    for k, ratings in enumerate(pairs_of_ratings):
        n = len(ratings)
        ratings = [(1000 * x, 1000 * y) for x, y in ratings]
        sums = [sum(f(x, y) for x, y in ratings) for f in (
            lambda x, y: x, lambda x, y: y, lambda x, y: x * y, lambda x, y: x * x, lambda x, y: y * y)]
        rows.append((k, n or None, *[s if n else None for s in sums]))
    df = cf.with_spread(
        spark.createDataFrame(rows, "k int, n long, sx long, sy long, sxy long, sxx long, syy long")
    ).withColumn("rule", cf.similarity_case(F.lit(mean)))
    out = df.select("k", "rule", cf.similarity_weight(F.col("rule")).alias("w")).orderBy("k").collect()
    return [(r.rule, r.w) for r in out]


def test_similarity_ladder(spark):
    got = _ladder(spark, [
        [], [(4, 5)], [(1, 2)], [(1, 5)], [(3, 3)], [(1, 5), (2, 4)], [(1, 5), (2, 4), (3, 3)],
        [(3, 1), (3, 2), (3, 4), (3, 5)], [(1, 1), (1, 5), (5, 1), (5, 5)],
        [(1, 1), (2, 2), (3, 3), (5, 5)], [(1, 5), (2, 4), (4, 2), (5, 1)], [(1, 2), (2, 1), (4, 5), (5, 5)],
    ])
    assert [r for r, _ in got] == [
        "no_co_raters", "one_both_above", "one_both_below", "one_mixed", "one_mixed", "two_or_three", "two_or_three",
        "no_variance", "no_covariance", "pearson", "pearson", "pearson",
    ]
    weights = [w for _, w in got]
    assert weights[:9] == [0.65, 0.75, 0.8, 0.35, 0.35, 0.65, 0.65, 0.7, 0.95]
    assert weights[9] == pytest.approx(1) and weights[10] == pytest.approx(-1)
    assert 0 < weights[11] < 1


def _weights(spark, rows):
    return spark.createDataFrame(
        [(1, 1, j, 3.0, c, float(w)) for j, c, w in rows],
        "user_id long, item_id long, neighbor_id long, neighbor_stars double, copies long, w double",
    )


@pytest.mark.parametrize("n, kept", [(19, 19), (20, 20), (21, 20), (25, 20)])
def test_ties_go_to_smallest_ids(spark, n, kept):
    best = cf.top_neighbors(_weights(spark, [(j, 1, 0.65) for j in range(n, 0, -1)])).collect()
    assert sorted(r.neighbor_id for r in best) == list(range(1, kept + 1))


def test_copies_count_towards_the_cut(spark):
    best = cf.top_neighbors(_weights(spark, [(1, 15, 0.9), (2, 15, 0.8), (3, 1, 0.7)])).collect()
    assert {r.neighbor_id: r.copies for r in best} == {1: 15, 2: 5}


def test_neighbor_orders(spark):
    rows = [(1, 1, 0.2), (2, 1, -0.9), (3, 1, 0.5), (4, 1, -0.1), (5, 1, 0.1)]
    def ids(order, k=3):
        opts = cf.CFOptions(neighbors=k, order=order)
        return [r.neighbor_id for r in cf.top_neighbors(_weights(spark, rows), opts).orderBy("rank").collect()]
    assert ids("weight") == [3, 1, 5]
    assert ids("abs") == [2, 3, 1]
    assert ids("signed", 4) == [3, 1, 5, 2]
    with pytest.raises(ValueError):
        ids("other")


def test_zero_weights_blend_by_counts(spark):
    table = rating_table(_events(spark, [(1, 1, 5), (1, 2, 4), (2, 3, 2), (2, 3, 2), (3, 3, 2)]), ["ord"])
    asked = cf.classify_requests(spark.createDataFrame([(1, 3)], "user_id long, item_id long"), table)
    weights = _weights(spark, [(1, 1, 0.0), (2, 1, 0.0)]).withColumn("item_id", F.lit(3).cast("long"))
    row = cf.score_requests(asked, weights, table).collect()[0]
    assert (row.cf_case, row.trusted) == ("zero_weights", False)
    assert row.cf == pytest.approx((4.5 * 2 + 2.0 * 3) / 5)


def test_only_candidate_excluded_gives_user_mean(spark):
    rows = [(1, 1, 4), (2, 1, 2)]
    got = _predict(spark, rows, [(1, 1)], cf.CFOptions(exclude_target=True))
    assert got[1, 1] == ("no_neighbors", 4.0, False)


def test_requests_fold_and_unfold(spark):
    rows = [(1, 1)] * 5 + [(1, 2)]
    folded = fold_requests(spark.createDataFrame(rows, "user_id long, item_id long"))
    assert {(r.user_id, r.item_id): r.copies for r in folded.collect()} == {(1, 1): 5, (1, 2): 1}
    back = sorted(tuple(r) for r in expand_copies(folded, chunk=2).collect())
    assert back == [(1, 1, k) for k in range(1, 6)] + [(1, 2, 1)]


def test_row_range_is_global(spark):
    df = spark.range(0, 1000).select((F.lit(1000) - F.col("id")).alias("id")).repartition(7)
    got = sorted((r.row_no, r.id) for r in row_range(df, ["id"], 250, 260).collect())
    assert got == [(k, k + 1) for k in range(250, 260)]


def test_members_in_long_form(spark):
    table = rating_table(_events(spark, [(1, i, 3) for i in range(200)] + [(2, 1, 3), (2, 1, 4)]), ["ord"])
    rows = group_members(table, "user_id", "item_id").collect()
    assert sorted(r.item_id for r in rows if r.user_id == 1) == list(range(200))
    assert [(r.item_id, r.copies) for r in rows if r.user_id == 2] == [(1, 2)]


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch):
    from rateweave import session

    table = rating_table(_events(spark, [(u, i, 3) for u in range(20) for i in range(10)] + [(1, 1, 4)]), ["ord"])
    few = group_members(table, "item_id", "user_id")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    many = group_members(table, "item_id", "user_id")
    assert "RepartitionByExpression" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert many.rdd.getNumPartitions() == 10  # more than the session's 4
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert session.spread(table, "item_id", rows=80).rdd.getNumPartitions() <= 4


def test_order_lines_are_dealt_by_their_rows(spark, monkeypatch):
    import os

    from rateweave import session
    from rateweave.catalog.inputs import Inputs

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    few = Inputs(spark, data).bag()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    many = Inputs(spark, data).bag()
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (few, many)]
    assert [plan.count("RepartitionByExpression") for plan in plans] == [0, 2]
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_ranks_and_copies_come_from_one_sort(spark):
    rows = [(1, 15, 0.9), (2, 4, 0.8), (3, 9, 0.7), (4, 1, 0.6)]
    best = cf.top_neighbors(_weights(spark, rows))
    assert best.columns == ["user_id", "item_id", "neighbor_id", "neighbor_stars", "copies", "w", "rank"]
    assert {r.neighbor_id: (r.copies, r.rank) for r in best.collect()} == {1: (15, 1), 2: (4, 2), 3: (1, 3)}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("WindowGroupLimit") == 1


def test_pairs_that_are_met_in_rounds_have_the_same_sums(spark, monkeypatch):
    rng = random.Random(11)
    rated = {(u, i): float(rng.randint(1, 5)) for u in range(40) for i in range(25) if rng.random() < 0.4}
    table = spark.createDataFrame([(u, i, s, 1, s) for (u, i), s in rated.items()], "user_id long, item_id long, stars double, copies long, stars_sum double")
    pairs = spark.createDataFrame([(i, j) for i in range(25) for j in range(i, 25)], "lo long, hi long")
    whole = sorted(map(tuple, cf.pair_sums(table, pairs).collect()))
    written = []
    monkeypatch.setattr(cf, "PAIRS_PER_ROUND", 100)
    monkeypatch.setattr(cf, "materialize", lambda df, name, write=cf.materialize: written.append(name) or write(df, name))
    assert sorted(map(tuple, cf.pair_sums(table, pairs).collect())) == whole
    assert written.count("pair-sums") == cf.MOST_ROUNDS > 1
    for lo, hi, n, *_ in whole:
        assert n == sum((u, lo) in rated and (u, hi) in rated for u in range(40))
