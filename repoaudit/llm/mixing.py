"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order that is the same in every run, gets a virtual finish time: the words
its source has sent so far, itself included, divided by the source's target. A source may be sent twice, the second
pass behind the first. All entries are range-sorted by finish time, and the queue is cut where the running number of
words reaches the total budget; at that point every source has sent about its target.

Running sums never gather a source in one task: the shuffle order is cut into buckets, each summed by itself, and
bucket totals are added up over a table that has one row per source and bucket.

Defined cases: null text has no words; the null source is a source like any other, last in order; rows without words
are never taken and have no finish time beyond their predecessor's; identical rows are documents of their own;
an empty table has no targets and gives no rows. Extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.llm.common import documents, stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a multiple of all words, and the most a source may give as a multiple of its own.
SHARE, MOST = 1.5, 2.0
#: Each source's shuffled order is cut into 1024 runs: the leading 16 bits of the place less these.
CUT_BITS = 6
WORD = "[^ \\t-\\r]+"


def place(doc_id: Column, text: Column) -> Column:
    """Position in the shuffled order: a hash of the id and the text."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return F.md5(key.cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place, row`` of every row; ``place`` is its position in the shuffled order."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        place(F.col("doc_id"), text).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """``source, source_size, budget, target`` per source: shares of the budget by weight, none above ``MOST`` times its size.

    Sources are filled in order of their cap per unit of weight. Those before the first that is not filled get their
    cap; what is left is shared by weight among the rest.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)) + 1).cast("double")
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    behind = by_cap.rowsBetween(0, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("budget", SHARE * F.sum("source_size").over(whole))
        .withColumn("given", F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("given")) / F.sum("weight").over(behind))
        .withColumn("open", F.col("level") * F.col("weight") <= MOST * F.col("source_size"))
        .withColumn("share", F.min(F.when(F.col("open"), F.struct(F.col("given"), F.col("level")))).over(whole)["level"])
    )
    target = F.least(F.coalesce(F.col("share") * F.col("weight"), MOST * F.col("source_size")), MOST * F.col("source_size"))
    return filled.select("source", "source_size", "budget", target.alias("target"))


def running(rows: DataFrame, keys: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, over rows in order of the last key and ``order``, per other keys.

    The last key cuts the rows into runs that are summed by themselves; the sums of earlier runs are added.
    """
    *outer, run = keys
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*outer).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy(*keys)
        .agg(F.sum(value).alias("_n"))
        .select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return (
        rows.withColumn("_in", F.sum(value).over(inside))
        .join(shifts, same)
        .withColumn(out, F.col("_in") + F.col("_shift"))
        .drop("_in", "_shift", *(f"_{k}" for k in keys))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, place, size, source_size, target, copies`` of every row: how often the mix takes it."""
    rows = stage(sized(docs), "mix-sizes")
    cut = F.shiftright(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), CUT_BITS)
    sent = running(rows.withColumn("cut", cut), ["source", "cut"], "size", ["place", "doc_id"], "sent").drop("cut")
    goals = targets(rows).withColumnRenamed("source", "g_source")
    same = F.col("source").eqNullSafe(F.col("g_source"))
    passes = (
        sent.join(goals, same)
        .drop("g_source")
        .select("*", F.posexplode(F.array(F.col("sent"), F.col("sent") + F.col("source_size"))).alias("pass", "total"))
        .withColumn("finish", F.when(F.col("target") > 0, F.col("total") / F.col("target")).otherwise(F.lit(0.0)))
    )
    order = ["finish", "source", "place", "doc_id", "pass"]
    ranged = passes.drop("sent", "total").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    queue = running(stage(ranged, "mix-queue"), ["part"], "size", order, "used")
    fits = (F.col("used") <= F.col("budget")) & (F.col("size") > 0)
    return queue.groupBy("doc_id", "place", "size", "source_size", "target", "source", "row").agg(
        F.sum(fits.cast("long")).alias("copies")
    )


def taken(docs: DataFrame) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is taken."""
    often = mixed(docs).groupBy("place").agg(F.sort_array(F.collect_list("copies"), False).alias("often"))
    own = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")).select(
        "row", place(F.col("row.doc_id"), F.coalesce(F.col("row.text"), F.lit(""))).alias("place")
    )
    same = Window.partitionBy("place").orderBy(F.lit(1))  # identical rows share a place
    each = packed.join(often, "place").withColumn("nth", F.row_number().over(same))
    copies = each.select("row", F.element_at("often", F.col("nth")).alias("copies")).where("copies > 0")
    sent = copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return sent.select(*(F.col(f"row.`{c}`").alias(c) for c in own))


def op6_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
