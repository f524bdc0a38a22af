"""Line windows and shingles, computed inside the file row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.text import normalized_lines
from repoaudit.operators.findings import number_within
from repoaudit.session import stage

SHINGLE_LINES = 8
SHINGLE_MIN_CHARS = 60


def window_starts(lines: Column, step: int) -> Column:
    """Zero-based starts 0, step, 2*step, ... below the number of lines."""
    n = F.size(lines)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingles(files: DataFrame, language: Column, n: int = SHINGLE_LINES, min_chars: int = SHINGLE_MIN_CHARS) -> DataFrame:
    """One row per window of ``n`` normalised code lines: start and digest.

    The file row is expanded directly to digests; no per-file sort or window is needed.
    """
    norm = files.select("repo_id", "path", normalized_lines(F.col("text"), language).alias("norm"))
    none = F.array().cast("array<int>")
    starts = F.when(F.size("norm") >= n, F.sequence(F.lit(0), F.size("norm") - n)).otherwise(none)
    win = F.transform(
        starts,
        lambda i: F.struct(
            (i + 1).cast("int").alias("start"), F.array_join(F.slice(F.col("norm"), i + 1, n), "||").alias("body")
        ),
    )
    kept = F.filter(win, lambda w: F.length(w["body"]) - 2 * (n - 1) >= min_chars)
    hashed = F.transform(
        kept, lambda w: F.struct(w["start"].alias("start"), F.sha1(w["body"].cast("binary")).alias("digest"))
    )
    return norm.select("repo_id", "path", F.explode(hashed).alias("w")).select("repo_id", "path", "w.start", "w.digest")


def repeated(windows: DataFrame) -> DataFrame:
    """Occurrences of digests seen at least twice in their repository."""
    counts = windows.groupBy("repo_id", "digest").agg(F.count(F.lit(1)).alias("occurrences"))
    return windows.join(counts.where(F.col("occurrences") >= 2).select("repo_id", "digest"), ["repo_id", "digest"])


def duplicate_stats(windows: DataFrame) -> DataFrame:
    """Per file: windows whose digest occurs again, and distinct partner files that share one."""
    hits = stage(repeated(windows), "repeated")
    own = hits.groupBy("repo_id", "path").agg(F.countDistinct("start").cast("int").alias("duplicate_windows"))
    return own.join(partner_counts(hits.select("repo_id", "path", "digest").distinct()), ["repo_id", "path"])


def partner_counts(members: DataFrame) -> DataFrame:
    """Number of other files sharing at least one digest with each file, without pairing files.

    A block copied into very many files would give a quadratic number of pairs. Instead
    every file gets a dense number inside its repository and every digest a bitmap of the
    files that hold it; a file's partners are the bits of the union of its digests'
    bitmaps. Files with the same set of digests share one such union.
    """
    files = members.select("repo_id", "path").distinct()
    numbered = stage(number_within(files, "repo_id", ["path"], "file_no"), "file-no")
    keyed = members.join(numbered, ["repo_id", "path"])
    bits = (
        keyed.select(
            "repo_id",
            "digest",
            F.bitmap_bucket_number("file_no").alias("bucket"),
            F.bitmap_bit_position("file_no").alias("bit"),
        )
        .groupBy("repo_id", "digest", "bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    classes = members.groupBy("repo_id", "path").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set("digest")), ","), 256).alias("class")
    )
    class_digests = members.join(classes, ["repo_id", "path"]).select("repo_id", "class", "digest").distinct()
    unions = (
        class_digests.join(bits, ["repo_id", "digest"])
        .groupBy("repo_id", "class", "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .groupBy("repo_id", "class")
        .agg((F.sum("n") - 1).cast("int").alias("duplicate_partners"))
    )
    return classes.join(unions, ["repo_id", "class"]).select("repo_id", "path", "duplicate_partners")
