"""Filter interaction audit: what each filter removes at each step of every order in which the filters can run.

Method: one pass gives every document a mask of the filters it fails. The masks of a part (a language) with their
counts become a count-weighted decision diagram: a node asks one filter, its two branches hold the documents that
pass and fail it, equal sub-tables are one node, and every node knows the documents below it. Orders are visited by
swapping two adjacent levels at a time; the path on which everything passes gives the steps of an order.

Copies: the masks of equal texts differ only in the last filter, so texts are counted by their SHA-256 and part before
the smallest id of a text is looked up among a few rows. No group of copies is gathered.

Defined cases: a null text is an empty one, a null part the empty string; an empty table has no parts and no rows; a
null id is smaller than all others; rows that share the smallest id of a text all pass E, repeated rows count as
often as they occur; a document without a label row is neither good nor toxic, one with several is what any says.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.llm.common import NO_ID, documents, stage

FILTERS = "ABCDE"
WHITE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(docs: DataFrame) -> DataFrame:
    """``doc, part, mark, mask`` of every row: a digest of its text, and bits 0 to 3 for failing A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("mark"),
        F.filter(F.split(text, WHITE), lambda w: w != "").alias("words"),
        F.length(text).alias("chars"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("capitals"),
        text.rlike("[#$%&*|]").alias("symbol"),
    )
    n = F.size("words")
    failing = [
        n < 200,
        100 * F.size(F.array_distinct("words")) < 50 * n,
        F.lit(100).cast("long") * F.col("capitals") > F.lit(3).cast("long") * F.col("chars"),
        F.col("symbol"),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing)), F.lit(0))
    return rows.select("doc", "part", "mark", mask.cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good ones and toxic ones by part and set of failed filters."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        *(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))
    )
    rows = text_failures(docs)
    named = rows.join(said, F.col("doc") == F.col("of"), "left").select(
        *rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))
    )
    keys = ["mark", "part", "mask", "good", "toxic"]
    per_id = named.groupBy(*keys, "doc").agg(F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("doc").alias("low"), F.min_by("n", "doc").alias("n_low")
    )
    text = Window.partitionBy("mark")  # a text has a row for each part and label at most
    first = F.when(F.col("low") == F.min("low").over(text), F.col("n_low")).otherwise(0)
    last = 1 << (len(FILTERS) - 1)
    split = groups.withColumn("first", first).select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("first").alias("n")),
                F.struct(F.col("mask").bitwiseOR(F.lit(last)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
            )
        ).alias("x"),
    )
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("n"), *(F.sum(n * F.col(c)).alias(c) for c in ("good", "toxic"))
    )


class Diagram:
    """A decision diagram over filters whose leaves are count vectors; every path asks every filter."""

    def __init__(self, leaves: dict[int, tuple[int, ...]], filters: str, width: int):
        self.order = list(range(len(filters)))
        self.names = filters
        self.numbers: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.sums: list[tuple[int, ...]] = []
        nothing = (0,) * width

        def build(level: int, mask: int) -> int:
            if level == len(self.order):
                return self._node(("leaf", leaves.get(mask, nothing)))
            bit = 1 << self.order[level]
            return self._node((self.order[level], build(level + 1, mask), build(level + 1, mask | bit)))

        self.root = build(0, 0)

    def _node(self, key: tuple) -> int:
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.nodes)
            self.nodes.append(key)
            leaf = key[0] == "leaf"
            self.sums.append(key[1] if leaf else tuple(map(sum, zip(self.sums[key[1]], self.sums[key[2]], strict=True))))
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of two adjacent levels; nodes above are renewed, nodes below stay."""
        done: dict[tuple[int, int], int] = {}

        def renew(node: int, depth: int) -> int:
            if (node, depth) not in done:
                name, passed, failed = self.nodes[node]
                if depth:
                    key = (name, renew(passed, depth - 1), renew(failed, depth - 1))
                else:
                    (below, pp, pf), (_, fp, ff) = self.nodes[passed], self.nodes[failed]
                    key = (below, self._node((name, pp, fp)), self._node((name, pf, ff)))
                done[node, depth] = self._node(key)
            return done[node, depth]

        self.root = renew(self.root, level)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Filter, counts kept and counts removed at each step of the present order."""
        node = self.root
        while self.nodes[node][0] != "leaf":
            name, node, failed = self.nodes[node]
            yield name, self.sums[node], self.sums[failed]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, to visit every order of ``n`` filters from the first on."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:  # the last filter travels through, then the others take one step
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def steps(leaves: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """``filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of all orders."""
    diagram = Diagram(leaves, filters, len(COUNTS))
    walks = [list(diagram.path())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        walks.append(list(diagram.path()))
    failing = {w[0][0]: w[0][2][0] for w in walks}
    alone = {w[-1][0]: w[-1][2][0] for w in walks}
    total = dict.fromkeys(failing, 0)
    for walk in walks:
        for name, _, gone in walk:
            total[name] += gone[0]
    return [
        ("".join(filters[name] for name, *_ in walk), at, kept[0], gone[0], failing[f] - gone[0], alone[f], *gone[1:], total[f])
        for walk in walks
        for at, (f, kept, gone) in enumerate(walk, 1)
    ]


def _audited(filters: str):
    names = [c.split()[0] for c in STEPS.split(", ")]

    def run(batches):
        for batch in batches:
            for part, entries in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows = steps({x["mask"]: tuple(x[c] for c in COUNTS) for x in entries}, filters)
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), *columns], names=names)

    return run


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of every order of the filters, for every part of ``part, mask, n, good, toxic``."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # 2 ** filters at most
    return parts.mapInArrow(_audited(filters), STEPS)


def op13_filter_audit(spark, sf_dir):
    counts = mask_counts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(stage(counts, "filter-masks"))
