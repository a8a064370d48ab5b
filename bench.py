"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores, BENCH_SHARED_DIR the folder
for tables that are written on the way (default a new temporary one).
Each query is built and run in full, with its result aggregated or discarded on the
executors. ``hybrid_score`` is the published end-to-end figure's counterpart: collaborative
filtering, features, scoring with two fitted models and blending for all requests.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rateweave.catalog import queries as registered  # noqa: E402
from rateweave.catalog.inputs import ORDER, Inputs  # noqa: E402
from rateweave.plans import pipeline  # noqa: E402

HEADLINE = (
    "cf_predict", "cf_predict_dense", "similarity_ladder", "topk_neighbors", "feature_frame", "training_frame",
    "friend_item_mean", "hybrid_blend", "eval_rmse",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rateweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="rateweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    named = registered.queries()
    seconds: dict[str, float] = {}

    def timed(name, make) -> None:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    named["entity_means"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    for name in HEADLINE:
        timed(name, lambda: named[name](spark, sf_dir))

    i = Inputs(spark, sf_dir).store()  # the events stand for the input files
    start = time.perf_counter()
    fitted = pipeline.train_models(registered.sources(i), i.val(), (registered.QUICK_A, registered.QUICK_B))
    fit_seconds = round(time.perf_counter() - start, 3)
    timed("hybrid_score", lambda: pipeline.predict(
        i.requests(), [i.train(), i.val()], ORDER, registered.sources(i), fitted
    ))
    rows = i.requests().count()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "fit_sec": fit_seconds,
        "rows_scored": rows, "rows_scored_per_sec": round(rows / seconds["hybrid_score"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
