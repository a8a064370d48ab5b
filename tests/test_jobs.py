import glob
import json
import random

import pytest

from rateweave.operators import evaluate, features, hybrid, models
from rateweave.operators.ratings import rating_table, union_ratings
from rateweave.plans import jobs, pipeline
from rateweave.sources import readers, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A small data folder in the file formats, with a taste that can be learnt."""
    rng = random.Random(7)
    at = tmp_path_factory.mktemp("data")
    users, items = [f"u{k}" for k in range(40)], [f"b{k}" for k in range(30)]

    def stars(u, b):
        return float(max(1, min(5, int(u[1:]) % 3 + int(b[1:]) % 3 + 1)))

    pairs = [(u, b) for u in users for b in items if rng.random() < 0.4]
    cut = int(len(pairs) * 0.8)
    train, val = pairs[:cut], pairs[cut:]

    def ratings(name, rows):
        (at / name).write_text("user_id,business_id,stars\n" + "".join(f"{u},{b},{stars(u, b)}\n" for u, b in rows))

    def lines(name, rows):
        (at / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    ratings("train.csv", train)
    ratings("val.csv", val)
    (at / "requests.csv").write_text(
        "user_id,business_id\n" + "".join(f"{u},{b}\n" for u, b in val) + "nobody,b1\nu1,nothing\nnobody,nothing\nu1,b1\nu1,b1\n"
    )
    lines("business.json", [
        {"business_id": b, "stars": int(b[1:]) % 3 + 2.0, "review_count": 3, "is_open": 1, "latitude": 1.5,
         "longitude": -2.0, "attributes": {"GoodForKids": True, "WiFi": "no", "RestaurantsPriceRange2": "2"},
         "hours": {"Monday": "11:30-21:0"}} for b in items[:-2]
    ] + [{"business_id": "b28", "stars": 3.0, "review_count": 1, "is_open": 0, "latitude": 0.0, "longitude": 0.0,
          "attributes": None, "hours": None}])
    lines("user.json", [
        {"user_id": u, "name": "Ada" if k % 2 else "Bob", "average_stars": int(u[1:]) % 3 + 2.0, "review_count": k,
         "joined": f"201{k % 10}-01-02", "fans": 1, "funny": 0, "useful": 1, "cool": 2, "compliment_hot": 0,
         "compliment_note": 1, "friends": "None" if k % 5 == 0 else f"u{(k + 1) % 40}, u{(k + 3) % 40}"}
        for k, u in enumerate(users[:-1])
    ])
    lines("review_train.json", [
        {"user_id": u, "business_id": b, "stars": stars(u, b), "date": f"2016-0{k % 9 + 1}-11"}
        for k, (u, b) in enumerate(train)
    ])
    lines("checkin.json", [{"business_id": b, "time": {"Fri-0": 2, "Sat-3": 1}} for b in items[::2]])
    (at / "lookup.json").write_text(json.dumps({"ada": "F", "bob": "M"}, indent=1))
    return at, len(val) + 5, {(u, b): stars(u, b) for u, b in val}


def test_readers(spark, folder):
    at, n_requests, _ = folder
    assert readers.read_requests(spark, f"{at}/requests.csv").count() == n_requests
    # A ratings file can serve as requests; its third column is dropped.
    assert readers.read_requests(spark, f"{at}/val.csv").columns == ["user_id", "item_id"]
    assert readers.read_requests(spark, f"{at}/val.csv").filter("item_id is null").count() == 0
    row = readers.read_items(spark, f"{at}/business.json").filter("item_id = 'b0'").first()
    assert row.attributes["GoodForKids"] == "true" and row.hours == {"Monday": "11:30-21:0"}
    assert readers.read_users(spark, f"{at}/user.json", "joined").filter("member_since is null").count() == 0
    assert {tuple(r) for r in readers.read_lookup(spark, f"{at}/lookup.json").collect()} == {("ada", "F"), ("bob", "M")}


def test_spaced_header(spark, tmp_path):
    df = spark.createDataFrame([("u", "b", 2.5)], "user_id string, item_id string, prediction double")
    sinks.write_predictions(df.coalesce(1), str(tmp_path / "spaced"), spaced_header=True)
    sinks.write_predictions(df.coalesce(1), str(tmp_path / "plain"))
    def text(name):
        return open(glob.glob(f"{tmp_path}/{name}/*.csv")[0], newline="").read()
    assert text("spaced").startswith("user_id, business_id, prediction")
    assert text("spaced").splitlines()[1] == "u,b,2.5"
    assert text("plain") == "user_id,business_id,prediction\nu,b,2.5\n"


def test_train_and_predict(spark, folder, tmp_path):
    at, n_requests, truth = folder
    common = ["--data", str(at), "--models", str(tmp_path / "models"), "--since-field", "joined", "--lookup", f"{at}/lookup.json"]
    jobs.main(["train", *common, "--trees", "20", "--max-depth", "3"])
    out = str(tmp_path / "out")
    jobs.main(["predict", *common, "--requests", f"{at}/requests.csv", "--out", out])
    got = spark.read.schema("user_id string, item_id string, prediction double").option("header", True).csv(out)
    rows = got.collect()
    assert len(rows) == n_requests
    assert all(1 <= r.prediction <= 5 for r in rows)
    assert len([r for r in rows if (r.user_id, r.item_id) == ("u1", "b1")]) >= 2
    known = [(truth[r.user_id, r.item_id], r.prediction) for r in rows if (r.user_id, r.item_id) in truth]
    mean = sum(y for y, _ in known) / len(known)
    assert sum((y - p) ** 2 for y, p in known) < 0.7 * sum((y - mean) ** 2 for y, _ in known)
    # The same models give the same predictions again.
    again = str(tmp_path / "again")
    jobs.main(["predict", *common, "--requests", f"{at}/requests.csv", "--out", again])
    second = spark.read.schema(got.schema).option("header", True).csv(again).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, second))


def test_last_row_of_a_file_counts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\nu,b,5.0\nu,b,1.0\nu,c,2.0\nu,b,3.0\n")
    (tmp_path / "v.csv").write_text("user_id,business_id,stars\nu,c,4.0\nu,c,3.0\n")
    both = union_ratings(*(readers.read_ratings(spark, f"{tmp_path}/{n}.csv", k) for k, n in enumerate("rv")))
    table = rating_table(both, ("origin", "file_order"))
    assert {(r.item_id, r.stars, r.copies) for r in table.collect()} == {("b", 3.0, 3), ("c", 3.0, 3)}
    (tmp_path / "u.json").write_text("".join(
        json.dumps({"user_id": u, "average_stars": a, "friends": f, "joined": "2011-01-01"}) + "\n"
        for u, a, f in [("u", 5.0, "v, w"), ("v", 2.0, "u"), ("u", 1.0, None)]
    ))
    users = readers.read_users(spark, f"{tmp_path}/u.json", "joined")
    assert {(r.user_id, r.average_stars, r.friends) for r in users.collect()} == {("u", 1.0, None), ("v", 2.0, "u")}
    (tmp_path / "l.json").write_text('{"ada": "F"}\n{"bob": "M", "ada": "M"}\n')
    lookup = readers.read_lookup(spark, f"{tmp_path}/l.json", lines=True)
    assert {tuple(r) for r in lookup.collect()} == {("ada", "M"), ("bob", "M")}


def test_jobs_without_lookup_and_friends(spark, folder, tmp_path):
    at = folder[0]
    lonely = [json.loads(line) | {"friends": "None"} for line in open(f"{at}/user.json")]
    (at / "lonely.json").write_text("".join(json.dumps(u) + "\n" for u in lonely + lonely[:3]))
    common = ["--data", str(at), "--models", str(tmp_path / "m"), "--users-file", "lonely.json"]
    with pytest.raises(SystemExit, match="since-field"):
        jobs.main(["train", *common])
    common += ["--since-field", "joined"]
    jobs.main(["train", *common, "--trees", "2", "--max-depth", "2"])
    jobs.main(["predict", *common, "--requests", f"{at}/requests.csv", "--out", str(tmp_path / "out")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).count()
    assert rows == folder[1]


def test_evaluate_without_validation_ratings(spark, folder, tmp_path):
    at, _, truth = folder
    common = ["--data", str(at), "--models", str(tmp_path / "m"), "--since-field", "joined", "--train-only"]
    jobs.main(["train", *common, "--trees", "20", "--max-depth", "3"])
    jobs.main(["evaluate", *common, "--out", str(tmp_path / "out")])
    error = spark.read.option("header", True).csv(str(tmp_path / "out" / "error")).first()
    mean = sum(truth.values()) / len(truth)
    spread = (sum((y - mean) ** 2 for y in truth.values()) / len(truth)) ** 0.5
    assert int(error.n) == len(truth) and float(error.rmse) < 0.9 * spread
    buckets = spark.read.option("header", True).csv(str(tmp_path / "out" / "histogram")).collect()
    assert sum(int(r.n) for r in buckets) == len(truth)
    with pytest.raises(SystemExit):
        jobs.main(["evaluate", *common])


def test_open_means_are_weighted(spark):
    frame = spark.createDataFrame([(1.0, None, 3.0), (0.0, None, 1.0), (None, None, 9.0)], "lookup_code double, friend_item_mean double, w double")
    assert models.open_means(frame, "w") == {"lookup_code": 0.75, "friend_item_mean": 0.0}
    assert models.open_means(frame)["lookup_code"] == 0.5


def test_fits_repeat(spark, folder):
    at = folder[0]
    s = features.Sources(
        readers.read_users(spark, f"{at}/user.json", "joined"), readers.read_items(spark, f"{at}/business.json"),
        readers.read_reviews(spark, f"{at}/review_train.json"), readers.read_checkins(spark, f"{at}/checkin.json"),
        readers.read_lookup(spark, f"{at}/lookup.json"),
    )
    small = models.Boosting(trees=2, depth=3, feature_share=0.7)
    val = readers.read_ratings(spark, f"{at}/val.csv")
    fits = [pipeline.train_models(s, val, (small,))[0].nodes.orderBy("tree", "node").collect() for _ in range(2)]
    assert len(fits[0]) > 4 and fits[0] == fits[1]


def test_predict_needs_requests(folder):
    with pytest.raises(SystemExit):
        jobs.main(["predict", "--data", "x", "--models", "y"])


def test_blend(spark):
    cf = spark.createDataFrame(
        [(1, 1, 4.0, True), (1, 2, 4.0, False), (1, 3, 5.0, True), (1, 4, 1.0, False)],
        "user_id long, item_id long, cf double, trusted boolean")
    scores = spark.createDataFrame(
        [(1, 1, 2.0), (1, 2, 2.0), (1, 3, 6.0), (1, 4, 0.5)], "user_id long, item_id long, model_score double")
    got = {r.item_id: r.prediction for r in hybrid.hybrid_blend(cf, scores).collect()}
    assert got == {1: pytest.approx(2.4), 2: pytest.approx(2.2), 3: 5.0, 4: 1.0}


def test_evaluation(spark):
    df = spark.createDataFrame([(5.0, 4.5), (5.0, 3.0), (1.0, 5.0), (2.0, 2.0)], "label double, prediction double")
    row = evaluate.rmse(df).first()
    assert (row.n, row.rmse) == (4, pytest.approx(((0.25 + 4 + 16) / 4) ** 0.5))
    assert [tuple(r) for r in evaluate.error_histogram(df).orderBy("bucket").collect()] == [
        (0, 2), (1, 0), (2, 1), (3, 0), (4, 1)]


def test_model_settings():
    a, b = models.MODEL_A, models.MODEL_B
    assert (a.trees, a.depth, a.feature_share, a.learning_rate, a.bins) == (1000, 6, 0.7, 0.05, 256)
    assert (a.l1, a.l2, a.base_score) == (0.2, 1.0, 1.0)
    assert (b.trees, b.depth, b.feature_share, b.learning_rate, b.bins) == (1000, 10, 0.8, 0.05, 256)


def test_bad_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\nu,b,5.0\nu,c,many\nu\nv,b,3.0,surplus\n,b,1.0\nw,c,\n")
    bad = readers.BadRows(str(tmp_path / "aside"), most_share=0.7)
    rows = readers.read_ratings(spark, f"{tmp_path}/r.csv", bad=bad).collect()
    assert sorted((r.user_id, r.item_id, r.stars) for r in rows) == [("u", "b", 5.0), ("v", "b", 3.0)]
    counts = {(r.source, r.reason): (r.n, r.of) for r in spark.read.parquet(f"{bad.path}/counts").collect()}
    assert sum(n for n, _ in counts.values()) == 4 and {of for _, of in counts.values()} == {6}
    found = spark.read.parquet(f"{bad.path}/rows/*").collect()
    assert {r.record for r in found if r.reason == "broken"} >= {"u,c,many"}
    with pytest.raises(readers.TooManyBadRows, match="4 of 6"):
        readers.read_ratings(spark, f"{tmp_path}/r.csv", bad=readers.BadRows(str(tmp_path / "other"), most_share=0.5))
    assert spark.read.parquet(f"{tmp_path}/other/rows/*").count() == 4  # also when the job fails
    (tmp_path / "i.json").write_text('{"business_id": "b", "stars": 4.0}\n{"business_id": \n{"stars": 1.0}\n{"business_id": "c", "stars": "x"}\n')
    bad = readers.BadRows(str(tmp_path / "items"), most_share=0.9)
    assert [r.item_id for r in readers.read_items(spark, f"{tmp_path}/i.json", bad).collect()] == ["b"]
    assert {r.reason: r.n for r in spark.read.parquet(f"{bad.path}/counts").collect()} == {"broken": 2, "no business_id": 1}
    assert [r.item_id for r in readers.read_items(spark, f"{tmp_path}/i.json").collect()] == ["b"]


def test_empty_ratings_are_none(spark):
    events = spark.createDataFrame([("u", "b", 4.0), ("u", "b", None), ("u", None, 2.0), ("v", "b", None)], "user_id string, item_id string, stars double")
    assert [tuple(r) for r in rating_table(events).collect()] == [("u", "b", 4.0, 1, 4.0)]
