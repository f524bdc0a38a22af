"""Incremental corpus scan: newly arrived files go through the same detectors as a full scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repoaudit.schemas import FILES


def scan_stream(
    spark: SparkSession, source: str, sink: str, detect: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True
):
    """Read arriving ``files`` parquet from ``source`` and keep findings per file in ``sink``.

    ``detect`` must be stateless per file. Each micro-batch writes the findings of its files
    under its own batch directory: a restarted batch replaces exactly its own output, so the
    sink is right after any failure. ``current_findings`` keeps the newest scan of a file.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        scanned = batch.select("repo_id", "path").distinct()
        found = scanned.join(detect(batch), ["repo_id", "path"], "left").withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        spark.readStream.schema(FILES).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return query.trigger(availableNow=True).start() if available_now else query.start()


def current_findings(spark: SparkSession, sink: str) -> DataFrame:
    """Findings of the newest scan of every file; files scanned clean leave no row."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sink}/batch=*")
    newest = rows.groupBy("repo_id", "path").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["repo_id", "path", "batch_id"]).where("category is not null").drop("batch_id")
