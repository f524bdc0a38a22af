"""A distributed radix sort, least significant digit first: ranks of rows under a composite integer key.

Rows lie in numbered blocks. A pass counts the digits of each block and gives every row its place among the rows of
its block with that digit; prefix sums over digits, and within a digit over blocks, turn that into the row's place
in the whole, and rows move to the block of their place. A pass is stable, so after the most significant digit the
places are the ranks. Blocks of all passes but the first are equally large whatever the keys are.

Passes are written to the shared folder. Besides, one row of least and largest key values and one row for each value
of a digit are all that meets in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.llm.common import discard, written

#: Bits of a digit at most.
DIGIT = 12
#: Rows of a block, least and most.
BLOCK = (4096, 1 << 20)


def digits(low: int, high: int, most: int = DIGIT) -> list[tuple[int, int]]:
    """``shift, width`` of the digits of a key from ``low`` to ``high``, least significant first."""
    bits = (high - low).bit_length()
    passes = -(-bits // most)
    width = -(-bits // passes) if passes else 0
    return [(i * width, width) for i in range(passes)]


def _placed(column: int, origin: int, falling: bool, shift: int, width: int):
    """Appends each row's digit and its place among the rows of its block with that digit."""

    def run(batches):
        block, seen = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(column).to_numpy().view(np.uint64)
            edge = np.uint64(origin % 2**64)
            key = edge - value if falling else value - edge  # modulo 2**64
            digit = ((key >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            blocks, place = batch.column(0).to_numpy(), np.empty(len(digit), np.int64)
            cuts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if block != blocks[a]:
                    block, seen = blocks[a], np.zeros(1 << width, np.int64)
                own = digit[a:b]
                counts = np.bincount(own, minlength=1 << width)
                order = np.argsort(own, kind="stable")
                sorted_digits = own[order]
                place[a + order] = np.arange(b - a) - (np.cumsum(counts) - counts)[sorted_digits] + seen[sorted_digits]
                seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digit.astype(np.int32)), pa.array(place)],
                names=[*batch.schema.names, "_digit", "_place"],
            )

    return run


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` (1, 2, 3...) under ``keys``, and their number.

    ``keys`` are ``(column, falling)`` of columns of type long without nulls, most significant first. ``rows`` has
    ``_block`` and ``_at`` (long) as its first columns: where a row lies at first. Rows with equal keys keep that order.
    """
    spark = rows.sparkSession
    ends = [f(c).alias(f"{n}{i}") for i, (c, _) in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))]
    about = rows.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    if not about.n:
        return rows.drop("_block", "_at").withColumn("rank", F.lit(None).cast("long")), 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(about.n // (4 * partitions), BLOCK[0]), BLOCK[1])
    own = [c for c in rows.columns if c not in ("_block", "_at")]
    current, current_at = rows, None
    for i, (column, falling) in reversed(list(enumerate(keys))):
        low, high = about[f"low{i}"], about[f"high{i}"]
        for shift, width in digits(low, high):
            laid = current.repartition("_block").sortWithinPartitions("_block", "_at")
            step = _placed(rows.columns.index(column), high if falling else low, falling, shift, width)
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            placed, at = written(laid.mapInArrow(step, f"{kinds}, _digit int, _place long"), f"{name}-digits")
            counts = placed.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("n"))
            before = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** DIGIT rows at most
            bases = counts.groupBy("_digit").agg(F.sum("n").alias("n")).select(
                "_digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base")
            )
            offsets = counts.select("_digit", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(
                bases, "_digit"
            )
            moved = placed.join(offsets, ["_digit", "_block"]).withColumn("_to", F.col("base") + F.col("start") + F.col("_place"))
            narrow = moved.select(F.expr(f"_to div {size}").alias("_block"), F.col("_to").alias("_at"), *own)
            after, after_at = written(narrow, f"{name}-moved")
            discard(spark, at, *([current_at] if current_at else []))
            current, current_at = after, after_at
    if current_at is None:  # all keys are equal: one pass over a digit of no bits numbers the rows
        order = Window.partitionBy("_block").orderBy("_at")
        sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
        starts = sizes.select("_block", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        numbered = rows.withColumn("_nth", F.row_number().over(order)).join(starts, "_block")
        return numbered.select(*own, (F.col("start") + F.col("_nth")).alias("rank")), about.n
    return current.select(*own, (F.col("_at") + 1).alias("rank")), about.n
