"""Helpers shared by the text operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoaudit.session import shuffles_removed, stage, stage_path

#: Stands for a null document id in sort keys and joins.
NO_ID = -(2**63)
#: Texts handed to one Python call; a single longer text goes alone.
BATCH_BYTES = 8 * 1024 * 1024

#: Columns that name a row.
ROW = ["doc", "row_key", "key"]

__all__ = ["NO_ID", "ROW", "discard", "documents", "keyed", "narrow_batches", "stage", "stage_path", "texts", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of texts by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc, row_key, text, key`` of every row: the id as a sort key, the text, and 31 and 64 independent bits of it.

    Columns named in ``more`` follow. ``ROW`` names a row: rows with one id, or none, are told apart by 95 bits of their texts.
    """
    narrow_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("row_key"),
        text.alias("text"),
        F.xxhash64(F.lit(1), text).alias("key"),
        *more,
    )


def real_id(doc: Column) -> Column:
    """The document id behind a sort key."""
    return F.when(doc != F.lit(NO_ID), doc)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its place."""
    path = stage_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
