"""The shape of the physical plans: no nested loops, no Python workers, pruned scans."""

import os
from dataclasses import replace

import pytest

from rateweave.catalog import oracles, queries
from rateweave.session import cut_lineage, fresh_path, materialize, shared_dir

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", [
    "cf_predict", "cf_candidates", "feature_frame", "friend_item_mean", "hybrid_blend", "impute_mean", "eval_rmse",
])
def test_no_nested_loops_and_no_python(spark, name):
    plan = _plan(queries.queries()[name](spark, DATA))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert word not in plan, word


@needs_data
def test_scans_read_only_what_is_used(spark):
    plan = _plan(queries.queries()["feat_activity_counts"](spark, DATA))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan


@needs_data
def test_rank_filter_runs_before_the_shuffle(spark):
    plan = _plan(queries.queries()["topk_neighbors"](spark, DATA))
    assert plan.count("WindowGroupLimit") >= 2


def test_every_sql_twin_has_a_query():
    names = set(queries.queries())
    twins = set(oracles.oracle_sql())
    assert twins <= names
    assert names - twins == {"gbt_predict", "hybrid_predict"}


@needs_data
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_match_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "QUICK_A", replace(queries.QUICK_A, depth=3))  # the facts hold for shallow trees too
    monkeypatch.setattr(queries, "QUICK_B", replace(queries.QUICK_B, depth=3))
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.sql(oracles.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)

    def plain(rows, names):
        at = [names.index(c) for c in columns]
        return sorted([tuple(row[k] for k in at) for row in rows], key=repr)

    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_stored_tables_live_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert fresh_path(spark, "x").startswith(named) and fresh_path(spark, "x") != fresh_path(spark, "x")
    df = materialize(spark.range(5), "five")
    assert df.inputFiles()[0].startswith("file://" + named)
    assert cut_lineage(df).count() == 5


@needs_data
@pytest.mark.parametrize("name", ["gbt_predict", "hybrid_predict"])
def test_predictions_fit_the_full_models(spark, monkeypatch, name):
    class Fitted(Exception):
        pass

    def fit(frame, features, fills, b, *args, **more):
        raise Fitted(b)

    monkeypatch.setattr(queries.boosting, "fit", fit)
    with pytest.raises(Fitted) as asked:
        queries.queries()[name](spark, DATA)
    assert asked.value.args[0] in (queries.models.MODEL_A, queries.models.MODEL_B) and asked.value.args[0].trees == 1000
