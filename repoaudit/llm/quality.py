"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Counts of a text are taken in one pass. Each measure is a whole number above zero (rates count one occurrence more
than there are, so that texts without any still differ by their length) and goes to a sketch of logarithmic buckets: a
value keeps its eight leading bits, so a bucket is at most a 128th wide and sketches merge by adding counts. Fences are
Tukey's on the scale of ratios: the third quartile times the ratio of the quartiles to the power of the measure's reach,
and for the mean word length the first quartile divided by it. Quartiles are those of the text's language and source,
or of its language, or of all texts where the finer group has fewer than ``LEAST`` texts. No threshold is a constant.
Texts join their group's fences and fail outside them. Texts that fail the base rules do not enter sketches. Repeated words have no
fence: the base rule alone decides on them.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows count as often as they occur; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import documents, narrow_batches, stage, texts
from repoaudit.llm.wordhash import window_hashes, word_numbers

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: Texts a group needs for fences of its own.
LEAST = 100
#: Ratios of the quartiles beyond the quartiles.
REACH = {"symbol_rate": 2, "dup_line_rate": 3, "mean_chars": 5}
#: Leading bits that a value keeps in a sketch.
BITS = 8
COUNTED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(found: list[bytes], size: int = WINDOW) -> int:
    """Words in windows that occur at least twice in the text."""
    if len(found) <= size:
        return 0
    hashes = window_hashes(word_numbers(found), size)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    starts = order[np.r_[same, False] | np.r_[False, same]]
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def _counts(batches):
    for batch in batches:
        rows = []
        for text in texts(batch.column(3)):
            found = text.split()
            lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
            chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([w])) for w in WHITE)
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            rows.append((len(found), chars, symbols, len(lines) - len(set(lines)), repeated_words(found)))
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(c) for c in columns)],
            names=["doc_id", "lang", "source", *(c.split()[0] for c in COUNTED.split(", "))],
        )


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def bucket_end(start: Column) -> Column:
    """The largest value of a bucket."""
    return start + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(start)) - BITS, F.lit(0))) - 1


MEASURES = {
    "symbol_rate": "(n_symbols + 1) * 1000000 div word_chars",
    "dup_line_rate": "(n_dup_lines + 1) * 1000000 div n_words",
    "mean_chars": "word_chars * 1000 div n_words",
}


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts, the measures and ``base_failed`` of every row."""
    narrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    rows = narrow.mapInArrow(_counts, f"doc_id long, lang string, source string, {COUNTED}")
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return rows.select(
        "*",
        failed.alias("base_failed"),
        *(F.when(F.col("n_words") > 0, F.greatest(F.expr(e), F.lit(1))).alias(m) for m, e in MEASURES.items()),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: one mergeable sketch per language, source and measure."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES))
    return (
        rows.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``n, low, high`` per ``keys`` and measure: texts, and the buckets of the first and third quartile."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    parts = merged.groupBy(*keys, "measure").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("parts")
    )  # a sketch has at most 128 buckets for each of 64 powers of two

    def at(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit"))
        return F.aggregate(
            "parts",
            start,
            lambda s, p: F.struct(
                (s["seen"] + p["n"]).alias("seen"),
                F.coalesce(s["hit"], F.when((s["seen"] + p["n"]) * 4 >= F.col("n") * int(share * 4), p["bucket"])).alias("hit"),
            ),
            lambda s: s["hit"],
        )

    return parts.select(*keys, "measure", "n", at(0.25).alias("low"), bucket_end(at(0.75)).alias("high"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source with an upper fence per measure and a lower one for the mean word length."""
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    own, per_lang, of_all = quartiles(sketch, "lang", "source"), named(quartiles(sketch, "lang"), "p"), named(quartiles(sketch), "a")
    joined = own.join(
        per_lang, F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("measure") == F.col("p_measure"))
    ).join(of_all, F.col("measure") == F.col("a_measure"))

    def pick(c: str) -> Column:
        coarse = F.when(F.col("p_n") >= LEAST, F.col(f"p_{c}")).otherwise(F.col(f"a_{c}"))
        return F.when(F.col("n") >= LEAST, F.col(c)).otherwise(coarse).cast("double")

    wide = joined.select("lang", "source", "measure", pick("low").alias("q1"), pick("high").alias("q3")).withColumn("r", F.col("q3") / F.col("q1"))
    times = lambda m: reduce(mul, [F.col("r")] * REACH[m])
    upper = [F.max(F.when(F.col("measure") == m, F.col("q3") * times(m))).alias(f"most_{m}") for m in MEASURES]
    lower = F.max(F.when(F.col("measure") == "mean_chars", F.col("q1") / times("mean_chars")))
    return wide.groupBy("lang", "source").agg(*upper, lower.alias("least_mean_chars"))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, measures, fences and ``kept`` of every row."""
    rows = stage(counts(docs), "quality-counts")
    limits = fences(sketches(rows)).select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "least_mean_chars", *(f"most_{m}" for m in MEASURES)
    )
    both = rows.join(
        limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left"
    ).drop("f_lang", "f_source")
    inside = F.col("mean_chars") >= F.col("least_mean_chars")
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"most_{m}"))
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def op5_quality(spark, sf_dir):
    names = [c.split()[0] for c in COUNTED.split(", ")]
    return judged(documents(spark, sf_dir)).select("doc_id", *names, "base_failed", "kept")
