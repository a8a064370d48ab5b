"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows that a task sorts or hashes where their number is known.
ROWS_PER_TASK = 1_000_000
#: Seconds that a step takes at least for its shuffle files to be removed at once.
RELEASE_AFTER = 5.0


def build_session(app: str = "rateweave", **conf: str) -> SparkSession:
    """A session for the jobs. Executor counts and sizes stay with ``spark-submit``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine; on a
    cluster such a folder would be lost with the machine, so the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    already = sc.getCheckpointDir()
    if already:
        return already
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rateweave-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in one folder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/rateweave/{app}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    For results that several branches of a plan start from: each branch then reads only
    its columns, with real sizes to plan by, and nothing is recomputed after an
    executor is lost.
    """
    path, start = fresh_path(df.sparkSession, name), time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - start >= RELEASE_AFTER:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over removed.

    Spark removes files that no plan refers to any longer once the driver's memory has been collected, which by itself may not happen for half an hour: by
    then those of all steps lie on the executors' disks side by side.
    """
    spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``df``, of so many rows, dealt by ``keys`` over as many tasks as keep each below ``ROWS_PER_TASK`` rows.

    The session's number of shuffle partitions is fixed, so that a task's sorts and hash tables would grow with the table. Where that
    number is enough, nothing changes.
    """
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def together(*steps: Callable[[], DataFrame]) -> tuple[DataFrame, ...]:
    """Run steps that write independent tables at the same time, so that they share the executors."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return tuple(done.result() for done in [pool.submit(step) for step in steps])
