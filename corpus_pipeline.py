"""Training-text pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the last return
the columns of their input. SQL can express neither the fitted trees of the first stage nor the tokenizer of the last,
so there is no statement for the whole.

Defined cases: a null text is an empty one and goes through all stages; a null id is below all others, and in the near
duplicates a row without an id is a document of its own; of identical rows one stays there; ties go to the smaller id;
an empty table gives no rows; columns of any other name are passed through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoaudit.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from repoaudit.llm.common import documents, stage, stage_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of ``toxicity.LIMIT`` or more go."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay as often as the mix takes them, at most twice."""
    return mixing.taken(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and for every row its place in them and a checksum of its ids as read back."""
    return token_output.token_digests(docs, stage_path(spark, "pipeline-tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
