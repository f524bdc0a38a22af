"""Findings as rows: building them inside a file row, de-duplicating, counting, ranking, numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.functions.paths import lookup
from repoaudit.schemas import FINDING, SEVERITIES
from repoaudit.session import stage

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
FINDING_KEY = ["repo_id", "category", "path", "line", "title"]


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(category, severity, confidence, title, line=None, evidence=None, **extra) -> Column:
    """One finding struct with the full field set; absent fields are null."""
    values = {
        "category": as_col(category),
        "severity": as_col(severity),
        "confidence": as_col(confidence),
        "title": as_col(title),
        "line": as_col(line),
        "evidence": F.array(*[as_col(e) for e in evidence]) if isinstance(evidence, list) else as_col(evidence),
        **{k: as_col(v) for k, v in extra.items()},
    }
    fields = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields
    ]
    return F.struct(*fields)


def per_file(files: DataFrame, *candidates: Column, keep: list[str] | None = None) -> DataFrame:
    """Explode candidate findings (null when a rule does not apply) of each file row.

    All rules are evaluated in the one pass that reads the text. Equal findings of
    one file are removed inside the row, so no shuffle is needed for de-duplication.
    """
    return expand(files, F.array_distinct(F.array_compact(F.array(*candidates))), keep)


def per_file_lists(files: DataFrame, *lists: Column, keep: list[str] | None = None) -> DataFrame:
    """As ``per_file`` for rules that give an array of findings each."""
    return expand(files, F.array_distinct(F.filter(F.concat(*lists), lambda f: f.isNotNull())), keep)


def expand(rows: DataFrame, found: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per finding struct of an array expression.

    The expression is handed to the generator itself: a filter on a projected array
    would be pushed below the projection and evaluate every rule a second time.
    """
    cols = keep or ["repo_id", "path"]
    return rows.select(*cols, F.posexplode(found).alias("emit_ord", "f")).select(*cols, "emit_ord", "f.*")


def per_repo(repos: DataFrame, *candidates: Column) -> DataFrame:
    """Findings about a repository as a whole: path ``.``."""
    return per_file(repos.withColumn("path", F.lit(".")), *candidates)


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First finding per key by emit order; the aggregation combines map-side."""
    keys = keys or FINDING_KEY
    rest = [c for c in found.columns if c not in keys]
    order = ["emit_ord"] + [c for c in rest if c != "emit_ord"]
    first = F.min(F.struct(*order)).alias("w")
    out = found.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest]).select(*found.columns)


def severity_counts(found: DataFrame, repos: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts of the four severities, zero filled; repositories without findings stay in."""
    by = by or ["repo_id"]
    counts = found.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total")
    )
    if repos is None:
        return counts
    return repos.select(*by).join(counts, by, "left").fillna(0, SEVERITIES + ["total"])


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("n"))


def category_map(found: DataFrame) -> DataFrame:
    """Sorted map of category counts per repository; only counted rows meet in the second step."""
    return (
        category_counts(found)
        .groupBy("repo_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    )


def severity_rank(col: Column | str = "severity") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), c), F.lit(9))


def confidence_rank(col: Column | str = "confidence") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv]), c), F.lit(9)
    )


def cap(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_findings(found: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Report rows: worst findings first, ranked inside each repository."""
    by = by or ["repo_id"]
    order = [severity_rank(), confidence_rank(), F.col("path"), F.coalesce(F.col("line"), F.lit(0)), F.col("category"), F.col("title")]
    w = Window.partitionBy(*by).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def number_within(df: DataFrame, group: str | list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Running number per group in a total order, without gathering a group in one task.

    Rows are range partitioned on (group, order), numbered inside each partition, and
    shifted by the counts of the earlier partitions. Only the (partition, group) counts
    meet in one place: one row per pair that occurs together, however large a group is.
    """
    groups = [group] if isinstance(group, str) else group
    placed = stage(
        df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), f"number-{out}"
    )
    inside = Window.partitionBy("_part", *groups).orderBy(*order)
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(shifts, [*groups, "_part"])
        .withColumn(out, (F.col("_rn") + F.col("_shift")).cast("int"))
        .drop("_rn", "_shift", "_part")
    )


def numbered_ids(found: DataFrame, prefix: str) -> DataFrame:
    """Ids ``prefix-001`` in (path, line, emit order, category, title), per repository."""
    keyed = found.withColumn("_line", F.coalesce("line", F.lit(0)))
    return (
        number_within(keyed, "repo_id", ["path", "_line", "emit_ord", "category", "title"])
        .withColumn("id", F.format_string(f"{prefix}-%03d", "seq"))
        .drop("_line", "seq")
    )


def digest_id(prefix: str, kind: Column, path: Column, extra: Column | None = None) -> Column:
    """Id from content: first eight digits of a SHA-1 over ``kind:path:extra``."""
    text = F.concat(kind, F.lit(":"), path, F.lit(":"), extra if extra is not None else F.lit(""))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(text.cast("binary")), 1, 8))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key; ties go to the value that occurred first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def top_values(df: DataFrame, keys: list[str], value: str, order: str, n: int) -> DataFrame:
    """The ``n`` most frequent values per key as an ordered list, first occurrence breaking ties."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    ranked = counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(value).alias("v")))), lambda s: s["v"]).alias(
            "top"
        )
    )


def first_places(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values per key and where each occurred first."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("first"))


def ordered_distinct_rows(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values per key as rows, numbered by first occurrence; no list, whatever their number."""
    return number_within(first_places(df, keys, value, order), keys, ["first", value]).drop("first")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values per key in order of first occurrence, as one list.

    For values that a rule table or catalog bounds; ``ordered_distinct_rows`` keeps any number of them.
    """
    firsts = first_places(df, keys, value, order)
    pairs = F.array_sort(F.collect_list(F.struct("first", F.col(value).alias("v"))))
    return firsts.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def demote(severity: Column, when: Column) -> Column:
    """One severity step down where ``when`` holds; ``low`` stays."""
    lower = lookup(severity, {"critical": "high", "high": "medium", "medium": "low", "low": "low"})
    return F.when(when, lower).otherwise(severity)


def join_evidence(col: str = "evidence") -> Column:
    return F.array_join(col, " | ")


