"""Importance resampling towards a target distribution: hashed word runs, array-scored weights, radix-sorted ranks.

Method: every run of words is hashed to one of ``BUCKETS`` buckets. Counts of all documents and of the target texts
give one array of gains (log ratios, in thousandths); a document's weight is the floored mean of its gains, looked up
in that array, its score the weight plus Gumbel noise from its id. Ranks come from the distributed radix sort of
``radix`` over the score, falling, and the id, rising; the highest are drawn, without replacement.

What meets in the driver is the array of counts, whose size is a parameter.

Defined cases: a null or empty text has no features and weight 0; no documents, or no target texts, leave counts of
zero; texts below ``LEAST`` words are returned without a rank; repeated ids are ranked one after the other, rows that
are equal in score and id in the order in which they were read; a null id draws its noise as the empty id and comes
before all others. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import NO_ID, documents, narrow_batches, real_id, stage, texts
from repoaudit.llm.decontaminate import words
from repoaudit.llm.radix import ranked

BUCKETS, RUN, SEED, LEAST, PERCENT = 10_000, 1, 2024, 20, 10
#: Words remembered by one Python worker.
WORDS_KEPT = 300_000
SCORED = "_block long, _at long, doc long, n_words long, n_features long, weight long, score long"


class _Buckets(dict):
    """Feature to bucket; a full memory starts anew."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.size
        return value


@lru_cache(maxsize=1)
def _memory(size: int) -> _Buckets:
    return _Buckets(size)


def buckets(found: list[bytes], run: int = RUN, size: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``run`` consecutive words."""
    number = _memory(size).__getitem__
    parts = [np.fromiter(map(number, found), np.int64, len(found))]
    for k in range(2, run + 1):
        runs = [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
        parts.append(np.fromiter(map(number, runs), np.int64, len(runs)))
    return np.concatenate(parts)


def _counted(run: int, size: int):
    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                total += np.bincount(buckets(words(text), run, size), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return count


def bucket_counts(rows: DataFrame, run: int = RUN, size: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket."""
    found = rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted(run, size), "bucket long, n long")
    total = np.zeros(size, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket at most
        total[r.bucket] = r.n
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    t_all, s_all, size = int(target.sum()), int(source.sum()), len(source)
    ratio = lambda t, s: (float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(t, s))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variable that only the id and the seed decide."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(shared_gains, run: int, seed: int):
    def score(batches):
        from pyspark import TaskContext

        gain, block, at = shared_gains.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = words(text)
                held = buckets(found, run, len(gain))
                weight = int(gain[held].sum()) // len(held) if len(held) else 0
                rows.append((block, at, doc, len(found), len(held), weight, weight + noise(None if doc == NO_ID else doc, seed)))
                at += 1
            columns = np.array(rows, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SCORED.split(", ")])

    return score


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc, n_words, n_features, weight, score`` of every row, and where it lies (``_block, _at``)."""
    spark = docs.sparkSession
    narrow_batches(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, run, size), bucket_counts(docs, run, size)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.mapInArrow(_scored(gain, run, seed), SCORED), "resample-scores")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, **parameters) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null for rows that are not drawn."""
    rows = scored(docs, target, **parameters)
    inside, n = ranked(rows.where(F.col("n_words") >= least), [("score", True), ("doc", False)], "resample")
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    columns = [real_id(F.col("doc")).alias("doc_id"), "n_features", "weight", "score"]
    outside = rows.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    return inside.select(*columns, drawn.alias("rank")).unionAll(outside)


def op12_resample(spark, sf_dir):
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
