"""Dependency structure: repository shape, tool findings, declaration gaps, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.operators.findings import expand, finding, per_repo, union_findings
from repoaudit.operators.tool_runs import issue_totals
from repoaudit.rules.surface import APPLICATION_LANGUAGE_BY_SUFFIX, PACKAGE_MANAGERS
from repoaudit.sources.corpus import select_surface

EXPORT_KEYS = ["exports", "nsExports", "types", "nsTypes", "enumMembers", "namespaceMembers"]
LOCKS = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock"]


def source_roots(files: DataFrame) -> DataFrame:
    """Distinct source roots with the language side they belong to."""
    path = F.col("path")
    side = P.application_language(path)
    return (
        select_surface(files, "structure")
        .select("repo_id", P.source_root(path).alias("root"), F.when(side == "python", "python").when(side.isNotNull(), "js").alias("side"))
        .where("root is not null")
        .distinct()
    )


def package_managers(files: DataFrame) -> DataFrame:
    """Managers implied by lock or manifest files at the root, in the fixed report order."""
    roots = dict(PACKAGE_MANAGERS)
    order = {name: i for i, (name, _) in enumerate(PACKAGE_MANAGERS)}
    hits = files.where(F.col("path").isin(list(roots))).select("repo_id", "path").distinct()
    flags = hits.groupBy("repo_id").agg(
        *[F.bool_or(F.col("path") == name).alias(f"_{i}") for name, i in order.items()]
    )
    return flags.select(
        "repo_id",
        F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(roots[n])) for n, i in order.items()])).alias("managers"),
    )


def manifest_managers(files: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """Second manager table: file names anywhere, each manager listed once in table order."""
    names = [n for n, _ in table]
    seen = files.where(P.name(F.col("path")).isin(names)).select("repo_id", P.name(F.col("path")).alias("n")).distinct()
    flags = seen.groupBy("repo_id").agg(*[F.bool_or(F.col("n") == n).alias(f"_{i}") for i, n in enumerate(names)])
    picks = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(m)) for i, (_, m) in enumerate(table)]))
    return flags.select("repo_id", F.array_distinct(picks).alias("managers"))


def workspace_roots(files: DataFrame) -> DataFrame:
    """Distinct package and project directories below the root, and the root itself with a workspace file."""
    src = select_surface(files, "structure").select("repo_id", "path")
    path = F.col("path")
    place = F.when(path == "pnpm-workspace.yaml", F.lit(".")).when(
        P.name(path).isin("package.json", "pyproject.toml") & path.contains("/"), P.parent(path)
    )
    return src.select("repo_id", place.alias("root")).where("root is not null").distinct()


def repo_profile(files: DataFrame) -> DataFrame:
    """Languages, root counts, shape and declaration flags per repository.

    Roots are counted, not listed: their rows are ``source_roots`` and ``workspace_roots``.
    """
    src = select_surface(files, "structure").select("repo_id", "path")
    path = F.col("path")
    lang = P.lookup(P.suffix(path), APPLICATION_LANGUAGE_BY_SUFFIX)
    base = src.groupBy("repo_id").agg(
        F.array_sort(F.collect_set(lang)).alias("languages"),
        F.countDistinct(P.source_root(path)).alias("n_source_roots"),
        F.bool_or(path == "package.json").alias("root_package"),
        F.bool_or(path == "pnpm-workspace.yaml").alias("root_workspace"),
        F.bool_or(path.isin(LOCKS)).alias("root_lock"),
    )
    spaces = workspace_roots(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_workspace_roots"))
    rows = (
        files.select("repo_id").distinct().join(base, "repo_id", "left").join(spaces, "repo_id", "left").fillna(0).fillna(False)
    )
    known = F.coalesce("languages", P.strings([]))
    return rows.select(
        "repo_id",
        F.when(F.size(known) > 0, known).otherwise(P.strings(["non-application"])).alias("languages"),
        "n_source_roots", "n_workspace_roots", "root_package", "root_workspace", "root_lock",
        F.when(F.col("n_workspace_roots") > 1, "workspace-monorepo")
        .when(F.col("n_source_roots") > 0, "single-package")
        .otherwise("repo-without-app-surface")
        .alias("shape"),
    )


def dep(category, severity, confidence, title, evidence: Column, scope: str, decision: str, notes=None) -> Column:
    return finding(
        category, severity, confidence, title, None, F.array(evidence), scope=scope, decision=decision, notes=notes
    )


def profile_findings(profile: DataFrame) -> DataFrame:
    """Findings from repository shape alone."""
    applies = ~F.array_contains("languages", "non-application")
    return per_repo(
        profile,
        F.when(
            ~applies,
            dep(
                "scan-blocker", "medium", "high",
                "This repository does not expose a real Python or JS/TS dependency graph target",
                F.lit("No Python or JS/TS application surface was found outside ignored directories, so a dependency graph audit would be theater."),
                "repo", "defer",
            ),
        ),
        F.when(
            applies & F.col("root_package") & ~F.col("root_lock"),
            dep(
                "dependency-declaration-gap", "medium", "high", "JS/TS dependency metadata has no visible lockfile",
                F.lit("A package.json is present but no npm, pnpm, or yarn lockfile was detected."),
                "package-manager", "fix-config",
            ),
        ),
        F.when(
            applies & (F.col("n_workspace_roots") > 1) & ~(F.col("root_workspace") | F.col("root_package")),
            dep(
                "orphan-or-isolated-module", "medium", "medium",
                "The repo looks multi-root, but workspace ownership is under-specified",
                F.lit("Multiple package or pyproject roots were detected without a clear top-level workspace declaration."),
                "workspace", "harden",
            ),
        ),
    )


def tool_findings(merged: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings from boundary, graph and unused-code tools; payload texts are reduced to totals first."""
    totals = issue_totals(runs.where(F.col("tool") == "knip"))
    key = F.col("key")
    knip = totals.groupBy("repo_id", "tool").agg(
        F.sum(F.when(key == "files", F.col("total"))).alias("t_files"),
        F.sum(F.when(key == "dependencies", F.col("total"))).alias("t_dependencies"),
        F.sum(F.when(key.isin(EXPORT_KEYS), F.col("total"))).alias("t_exports"),
        F.sum(F.when(key.isin("unresolved", "unlisted"), F.col("total"))).alias("t_unresolved"),
    )
    circular = runs.groupBy("repo_id", "tool").agg(
        F.bool_or(F.coalesce(F.lower("payload").contains("circular"), F.lit(False))).alias("circular")
    )
    rows = (
        merged.where(F.col("tool").isin("tach", "dependency-cruiser", "knip"))
        .join(circular, ["repo_id", "tool"], "left")
        .join(knip, ["repo_id", "tool"], "left")
        .fillna(0)
        .fillna(False)
        .withColumn("path", F.lit("."))
    )
    tool, status, summary = F.col("tool"), F.col("status"), F.col("summary")
    unconfigured = F.lower(F.array_join("details", " ")).contains("configuration file not found")
    note = F.array_join("details", " | ")
    tach_bad = (status == "failed") | unconfigured
    issues = status == "issues"
    cycle = F.col("circular")
    total = lambda c, label: F.concat(F.lit("Knip reported "), F.col(c).cast("string"), F.lit(f" {label} finding(s)."))
    knip_issue = (tool == "knip") & issues
    found = F.array_compact(
        F.array(
            F.when(
                (tool == "tach") & tach_bad,
                dep("config-gap", "high", "high", "Python boundary governance is not runnable yet", summary, "python", "fix-config", note),
            ),
            F.when(
                (tool == "tach") & ~tach_bad & issues,
                dep("architecture-violation", "high", "high", "Tach reported Python boundary or interface violations", summary, "python", "harden", note),
            ),
            F.when(
                (tool == "dependency-cruiser") & (status == "failed"),
                dep("config-gap", "medium", "high", "Dependency Cruiser did not complete successfully", summary, "js-ts", "fix-config", note),
            ),
            F.when(
                (tool == "dependency-cruiser") & issues,
                dep(
                    F.when(cycle, "cycle").otherwise("architecture-violation"), F.when(cycle, "high").otherwise("medium"),
                    "medium", "Dependency Cruiser reported JS/TS graph violations", summary, "js-ts", "harden", note,
                ),
            ),
            F.when(
                (tool == "knip") & (status == "failed"),
                dep("config-gap", "medium", "high", "Knip did not complete successfully", summary, "js-ts", "fix-config", note),
            ),
            F.when(knip_issue & (F.col("t_files") > 0), dep("unused-file", "medium", "high", "Knip reported unused files", total("t_files", "unused file"), "js-ts", "remove")),
            F.when(knip_issue & (F.col("t_dependencies") > 0), dep("unused-dependency", "medium", "high", "Knip reported unused dependencies", total("t_dependencies", "unused dependency"), "js-ts", "remove")),
            F.when(knip_issue & (F.col("t_exports") > 0), dep("unused-export", "low", "medium", "Knip reported unused exports", total("t_exports", "unused export"), "js-ts", "quarantine")),
            F.when(knip_issue & (F.col("t_unresolved") > 0), dep("unresolved-import", "high", "high", "Knip reported unresolved or unlisted imports", total("t_unresolved", "unresolved / unlisted dependency"), "js-ts", "fix-config")),
        )
    )
    return expand(rows, found)


def detect(files: DataFrame, merged: DataFrame, runs: DataFrame) -> DataFrame:
    """Shape findings, and tool findings for repositories that have an application surface."""
    profile = repo_profile(files)
    applies = profile.where(~F.array_contains("languages", "non-application")).select("repo_id")
    return union_findings(
        profile_findings(profile), tool_findings(merged, runs).join(applies, "repo_id", "left_semi")
    )


def verdict_rows(found: DataFrame, repos: DataFrame) -> DataFrame:
    c = F.col("category")
    counts = found.groupBy("repo_id").agg(
        F.count_if(c == "scan-blocker").alias("blockers"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(c == "config-gap").alias("gaps"),
        F.count_if(c.isin("unused-file", "unused-dependency", "unused-export")).alias("unused"),
        F.count_if(c.isin("architecture-violation", "cycle")).alias("boundary"),
        F.count(F.lit(1)).alias("total"),
    )
    rows = repos.select("repo_id").distinct().join(counts, "repo_id", "left").fillna(0)
    return rows.select(
        "repo_id",
        F.when((F.col("blockers") > 0) | (F.col("high") > 0), "scan-blocked")
        .when(F.col("gaps") >= 2, "baseline-needed")
        .when(F.col("unused") > 0, "cleanup-first")
        .when(F.col("boundary") > 0, "boundary-hardening")
        .when(F.col("total") > 0, "incremental-governance")
        .otherwise("well-governed")
        .alias("verdict"),
    )
