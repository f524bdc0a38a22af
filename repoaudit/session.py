"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "repoaudit", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs are tuned for; a cluster may override any of them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rows after a shuffle are often costly to process (JSON, texts): keep them on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64kb")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # rows that go to Python workers hold whole files
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; beside the warehouse on a local master that names none."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "stages")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return os.path.join(checkpoint_root(spark), f"run-{spark.sparkContext.applicationId}")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table."""
    return os.path.join(run_folder(spark), f"stage-{name}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that still read one must be written first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession) -> int:
    """Number of tasks for small rows that stand for much work, which adaptive execution would join to a few tasks."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Used where a pass over file texts feeds several later branches: the texts are
    read once, the narrow result is reliable against executor loss, and the
    read-back table has exact statistics for join planning. ``release`` removes
    the tables of an application.
    """
    spark = df.sparkSession
    target = stage_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
