"""Other inputs and outputs: lookup JSON, summaries with their load outcome, and the partitioned sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoaudit.operators.rule_index import RULES
from repoaudit.plans.rollup import bucket_of
from repoaudit.rules import catalog
from repoaudit.schemas import SEVERITIES
from repoaudit.sources.corpus import read_archives

ALIAS_SCHEMA = "package_aliases map<string, struct<provider: string, wrapper: string, surface_family: string, sdk: string>>, query_seeds map<string, array<string>>"
CONTRACT_SCHEMA = "skill string, overall_verdicts array<string>, rollup_map map<string, string>"


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Package alias table from a hints document."""
    raw = spark.read.schema(ALIAS_SCHEMA).json(path, multiLine=True)
    a = raw.select(F.explode("package_aliases").alias("name", "a"))
    family = F.coalesce("a.surface_family", F.lit("generic-wrapper"))
    return a.select(F.lower(F.trim("name")).alias("name"), "a.provider", "a.wrapper", family.alias("family"), F.coalesce("a.sdk", "name").alias("sdk"))


def read_query_seeds(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ALIAS_SCHEMA).json(path, multiLine=True)
    return raw.select(F.explode("query_seeds").alias("key", "seeds"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Line rules from JSON lines with the columns of ``rule_index.RULES``; absent flags are false."""
    rows = spark.read.schema(RULES).json(path)
    return rows.withColumn("every", F.coalesce("every", F.lit(False)))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict contracts as rows: skill, verdict, bucket."""
    raw = spark.read.schema(CONTRACT_SCHEMA).json(path, multiLine=True)
    return raw.select("skill", F.explode("rollup_map").alias("verdict", "bucket"))


def read_summary_tree(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<repo_id>/<domain>/summary.json`` documents of other tools as (repo_id, domain, json).

    Absent files give no row, whole files of any content give one: the roll-up tells missing from invalid.
    """
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="summary.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = lambda n: F.url_decode(F.replace(F.element_at(parts, n), F.lit("+"), F.lit("%2B")))
    return rows.select(name(-3).alias("repo_id"), name(-2).alias("domain"), F.col("value").alias("json"))


def read_summary_archives(spark: SparkSession, root: str) -> DataFrame:
    """The documents of ``read_summary_tree`` where the tree is kept in archives (``corpus.write_archives``)."""
    rows = read_archives(spark, root).where(F.substring_index("path", "/", -1) == "summary.json")
    parts = F.split(F.concat_ws("/", "repo_id", "path"), "/")
    return rows.select(F.element_at(parts, -3).alias("repo_id"), F.element_at(parts, -2).alias("domain"), F.col("content").cast("string").alias("json"))


def read_summaries(spark: SparkSession, root: str, run_id: str | None = None, domains: list[str] | None = None) -> DataFrame:
    """What ``write_summaries`` wrote, as (repo_id, domain, run_id, json); runs and domains not asked for are not opened.

    A line that is no JSON object has a null ``repo_id``; records of a newer schema than this library's are left out of
    no result: they are returned as they are, with their ``schema_version``.
    """
    rows = spark.read.schema("value string, domain string, run_id string").text(root)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if domains is not None:
        rows = rows.where(F.col("domain").isin(domains))
    version = F.coalesce(F.get_json_object("value", "$.schema_version").cast("int"), F.lit(1))
    return rows.select(
        F.get_json_object("value", "$.repo_id").alias("repo_id"), "domain", "run_id", version.alias("schema_version"), F.col("value").alias("json")
    )


def write_summaries(records: DataFrame, path: str) -> None:
    """One JSON record per line below ``domain=<d>/run_id=<r>``.

    Only the partitions that ``records`` holds are replaced, so that audits of one run are written one after the other
    and a repeated audit replaces its own records alone; the job commit makes the swap atomic.
    """
    columns = [c for c in records.columns if c not in ("domain", "run_id")]
    document = F.to_json(F.struct("domain", "run_id", *columns), {"ignoreNullFields": "false"})
    (
        records.select("domain", "run_id", document.alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("domain", "run_id")
        .text(path)
    )


#: Version of the records written here. Version 2 has one entry per category with its count; records of other tools
#: (version 1) have one entry per finding.
SUMMARY_VERSION = 2


def summary_documents(
    found: DataFrame, verdicts: DataFrame, domain: str, run_id: str, generated_at: str = "", skill: str | None = None
) -> DataFrame:
    """One record per verdict row with every key that a summary must have.

    ``findings`` of a record are one entry per category (bounded by the rule tables) with the number of findings, their
    worst severity and the first place, ordered by that place; the findings themselves stay a table of their own.
    """
    by_category = found.groupBy("repo_id", "category").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("path", F.coalesce(F.col("line"), F.lit(0)).alias("line"))).alias("first"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in SEVERITIES])
    entry = F.struct("first", "category", worst.alias("severity"), "count")
    counts = by_category.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), *[F.sum(s).alias(s) for s in SEVERITIES]
    )
    rows = verdicts.select("repo_id", "verdict").join(counts, "repo_id", "left").fillna(0)
    shown = F.transform(
        "entries",
        lambda e: F.struct(e["category"].alias("category"), e["severity"].alias("severity"), e["count"].alias("count"), e["first"]["path"].alias("path"), e["first"]["line"].alias("line")),
    )
    kind = "array<struct<category: string, severity: string, count: bigint, path: string, line: int>>"
    bucket = bucket_of(F.lit(domain), F.col("verdict"))
    place = lambda name: F.concat_ws("/", "repo_id", F.lit(f"{domain}/{name}"))
    none = F.array().cast("array<string>")
    return rows.select(
        "repo_id",
        F.lit(SUMMARY_VERSION).alias("schema_version"),
        F.lit(run_id).alias("run_id"),
        F.lit(skill or catalog.skill_of(domain)).alias("skill"),
        F.lit(domain).alias("domain"),
        F.col("repo_id").alias("repo_root"),
        F.lit(generated_at).alias("generated_at"),
        F.col("verdict").alias("overall_verdict"),
        F.coalesce(bucket, F.lit("")).alias("rollup_bucket"),
        F.lit("ready").alias("dependency_status"),
        none.alias("bootstrap_actions"),
        none.alias("dependency_failures"),
        F.struct(*SEVERITIES).alias("severity_counts"),
        F.coalesce(shown, F.array().cast(kind)).alias("findings"),
        place("summary.json").alias("summary_path"),
        place("report.md").alias("report_path"),
        place("agent-brief.md").alias("agent_brief_path"),
    )
