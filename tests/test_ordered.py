"""Ordered values as rows: one tool, and one key, with very many of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.operators.findings import ordered_distinct_rows
from repoaudit.operators.tool_runs import tool_details

MANY = 300_000


def test_details_of_one_tool_are_numbered_over_many_tasks(spark):
    runs = spark.range(MANY // 100).select(
        F.lit("r").alias("repo_id"), F.lit("tach").alias("tool"), (F.lit(MANY) - F.col("id")).cast("int").alias("batch"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.format_string("d%d", i)).alias("details"),
    )
    other = spark.createDataFrame([("r", "knip", 1, ["x", None, "x"]), ("q", "tach", 2, []), ("q", "tach", 1, None)], "repo_id string, tool string, batch int, details array<string>")
    rows = tool_details(runs.unionAll(other)).cache()
    big = rows.where("tool = 'tach'")
    assert big.count() == MANY and big.select("seq").distinct().count() == MANY and big.agg(F.max("seq")).first()[0] == MANY
    assert big.where((F.col("seq") - 1) % 100 != F.substring("detail", 2, 9).cast("int")).count() == 0
    assert [(r.seq, r.detail) for r in rows.where("tool = 'knip'").orderBy("seq").collect()] == [(1, "x"), (2, None), (3, "x")]


def test_values_of_one_key_keep_the_order_of_their_first_place(spark):
    rows = spark.range(2 * MANY).select(F.lit("k").alias("k"), F.lit(1).alias("g"), (F.col("id") % MANY).alias("v"), (F.lit(7 * MANY) - F.col("id")).alias("at"))
    few = spark.createDataFrame([("k", 2, 9, 5), ("k", 2, 8, 4), ("k", 2, 9, 1), ("k", 2, None, 0)], "k string, g int, v long, at long")
    got = ordered_distinct_rows(rows.unionAll(few), ["k", "g"], "v", "at").cache()
    big = got.where("g = 1")
    assert big.count() == MANY and big.where(F.col("seq") != F.lit(MANY) - F.col("v")).count() == 0
    assert [(r.seq, r.v) for r in got.where("g = 2").orderBy("seq").collect()] == [(1, 9), (2, 8)]
