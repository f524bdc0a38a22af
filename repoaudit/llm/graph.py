"""Connected components of links between documents, in rounds of minimum aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import discard, written


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, label`` of every node that has a link; the label is the smallest node it reaches.

    Links are ``a, b`` of type long. In each round a node hears the labels of its neighbours, tells the least one
    to its own label as well, and then takes its label's label. Every step is a join or a minimum that is combined
    before the shuffle, so no node's neighbours are gathered; every round's labels are written to the shared folder.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, edges_at = written(both.where("a <> b").distinct(), f"{name}-edges")
    labels, at = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels"
    )
    while True:
        heard = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("least"))
        told = heard.join(labels, F.col("at") == F.col("node")).select(
            F.explode(F.array("node", "label")).alias("node"), "least"
        )
        least = told.groupBy(F.col("node").alias("at")).agg(F.min("least").alias("least"))
        lower = labels.join(least, F.col("node") == F.col("at"), "left").select(
            "node", "label", F.least("label", F.coalesce("least", "label")).alias("now")
        )
        mid, mid_at = written(lower, f"{name}-heard")
        up = mid.select(F.col("node").alias("up"), F.col("now").alias("top"))
        jumped = mid.join(up, F.col("now") == F.col("up"), "left").select(
            "node", F.col("label").alias("was"), F.least("now", F.coalesce("top", "now")).alias("label")
        )
        now, now_at = written(jumped, f"{name}-labels")
        changed = now.where("label <> was").limit(1).count()
        discard(spark, mid_at, at)
        labels, at = now.select("node", "label"), now_at
        if not changed:
            discard(spark, edges_at)
            return labels
