"""Cleanup readiness: deprecation marks, shims, flags, dynamic entry points, evidence gaps, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import extract_first, fold, matches
from repoaudit.functions.text import line_of
from repoaudit.operators.findings import finding, per_file, per_repo, union_findings
from repoaudit.rules import cleanup as R
from repoaudit.rules.surface import (
    DOC_ROOT_NAMES,
    MANIFEST_KIND,
    NON_SOURCE_LANGUAGES,
    TOOLS_FOR_DOCS,
    TOOLS_FOR_JS,
    TOOLS_FOR_PYTHON,
)
from repoaudit.sources.corpus import repositories, select_surface


def cue_columns(files: DataFrame) -> DataFrame:
    """Per file: the extracted cues. Narrow columns only leave this step besides the text."""
    text, path = F.col("text"), F.col("path")
    code = P.is_code_or_config(path)
    low = F.col("low")
    return files.withColumn("low", fold(text)).select(
        "repo_id",
        "path",
        "text",
        code.alias("code"),
        P.language(path).alias("lang"),
        extract_first(text, R.REPLACEMENT, low).alias("replacement"),
        extract_first(text, R.REMOVAL_TARGET, low).alias("target"),
        extract_first(text, R.DEPRECATION, low).alias("cue"),
        (code & matches(path, R.SHIM_PATH)).alias("shim_path"),
        F.when(code, extract_first(text, R.SHIM_TEXT, low)).alias("shim_cue"),
        F.when(code, extract_first(text, R.FEATURE_FLAG, low)).alias("flag_cue"),
        F.when(code, extract_first(text, R.DYNAMIC_ENTRY, low)).alias("dynamic_cue"),
    )


def iso_date(value: Column) -> Column:
    """Strict ISO date, null for anything else (a version number, an impossible day)."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def detect_files(files: DataFrame, as_of) -> DataFrame:
    """File findings of the cleanup audit; ``as_of`` is the date removal targets are held against."""
    c = cue_columns(select_surface(files, "cleanup"))
    text, path = F.col("text"), F.col("path")
    cue, target, repl = F.col("cue"), F.col("target"), F.col("replacement")
    shim_path, shim_cue = F.col("shim_path"), F.col("shim_cue")
    marked = cue.isNotNull() | target.isNotNull()
    shown = F.coalesce(cue, target)
    is_shim = F.col("code") & shim_cue.isNotNull() & (shim_path | marked)
    matched = lambda col: F.array(F.concat(F.lit("matched cue: "), col))
    path_note = F.concat(F.lit("path suggests compatibility surface: "), path)
    common = {"language": F.col("lang"), "removal_target": target}
    gaps = F.concat_ws(
        ", ",
        F.when(F.coalesce(repl, F.lit("")) == "", F.lit("replacement")),
        F.when(F.coalesce(target, F.lit("")) == "", F.lit("removal target")),
    )
    return per_file(
        c,
        F.when(
            marked,
            finding(
                "deprecated-surface", "medium", F.when(cue.isNotNull(), "high").otherwise("medium"),
                R.TITLES["deprecated-surface"], line_of(text, shown), matched(shown), cue=shown, replacement=repl, **common,
            ),
        ),
        F.when(
            is_shim,
            finding(
                "compatibility-shim", "medium", F.when(shim_path, "medium").otherwise("low"),
                R.TITLES["compatibility-shim"], line_of(text, shim_cue),
                F.array_compact(F.array(F.when(shim_path, path_note), F.concat(F.lit("matched cue: "), shim_cue))),
                cue=shim_cue, replacement=repl, **common,
            ),
        ).when(
            shim_path & ~marked,
            finding(
                "cleanup-opportunity", "low", "low", R.TITLES["cleanup-opportunity"], None, F.array(path_note),
                replacement=repl, **common,
            ),
        ),
        F.when(
            iso_date(target) < F.lit(as_of).cast("date"),
            finding(
                "expired-removal-target", "high", "high", R.TITLES["expired-removal-target"], line_of(text, target),
                F.array(F.concat(F.lit("expired removal target: "), target)), replacement=repl, **common,
            ),
        ),
        F.when(
            marked & (gaps != ""),
            finding(
                "marker-gap", "medium", "medium", F.concat(F.lit(R.TITLES["marker-gap"]), gaps, F.lit(".")),
                line_of(text, cue), F.array(F.lit("deprecation cue without complete machine-readable metadata")),
                cue=cue, replacement=repl, **common,
            ),
        ),
        F.when(
            F.col("flag_cue").isNotNull(),
            finding(
                "feature-flag-debt", "medium", "medium", R.TITLES["feature-flag-debt"],
                line_of(text, F.col("flag_cue")), matched(F.col("flag_cue")), cue=F.col("flag_cue"), **common,
            ),
        ),
        F.when(
            F.col("dynamic_cue").isNotNull(),
            finding(
                "dynamic-entrypoint-risk", "high", "medium", R.TITLES["dynamic-entrypoint-risk"],
                line_of(text, F.col("dynamic_cue")), matched(F.col("dynamic_cue")), cue=F.col("dynamic_cue"),
                language=F.col("lang"),
            ),
        ),
    )


def manifests(files: DataFrame) -> DataFrame:
    """Manifest files by name or relative path, with their kind."""
    path = F.col("path")
    visible = ~path.rlike(r"(?:^|/)\.[^/]*/")
    kind = F.coalesce(P.lookup(P.name(path), MANIFEST_KIND), P.lookup(path, MANIFEST_KIND))
    named = files.where(visible).select("repo_id", "path", kind.alias("kind")).where("kind is not null")
    flows = files.where(path.startswith(R.WORKFLOW_DIR)).select(
        "repo_id", F.lit(".github/workflows").alias("path"), F.lit("ci").alias("kind")
    )
    return named.unionByName(flows.distinct())


def docs_roots(files: DataFrame) -> DataFrame:
    """Directories named like documentation roots, at any depth outside dot directories."""
    d = P.directories(F.col("path"))
    hits = F.filter(
        F.transform(d, lambda x, i: F.when(F.lower(x).isin(DOC_ROOT_NAMES), F.array_join(F.slice(d, 1, i + 1), "/"))),
        lambda x: x.isNotNull() & ~x.rlike(r"(?:^|/)\."),
    )
    return files.select("repo_id", F.explode(hits).alias("docs_root")).distinct()


def repo_profile(files: DataFrame) -> DataFrame:
    """Source languages and tool hints per repository, with manifest and documentation root counts.

    The lists here are bounded by the rule tables. Names that grow with a repository are
    rows of ``manifests`` and ``docs_roots``. Texts are never read for this.
    """
    slim = files.select("repo_id", "path")
    name = F.substring_index("path", "/", -1)
    source = slim.where(~F.col("path").rlike(r"(?:^|/)\.[^/]*/")).select("repo_id", P.language(F.col("path")).alias("v"))
    languages = (
        source.where(F.col("v").isNotNull() & ~F.col("v").isin(NON_SOURCE_LANGUAGES))
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_set("v")).alias("languages"))
    )
    found = manifests(slim).groupBy("repo_id").agg(
        F.collect_set("kind").alias("hints"),
        F.countDistinct("path").alias("n_manifests"),
        F.bool_or(name.isin("package.json", "tsconfig.json")).alias("js"),
        F.bool_or(name.isin("pyproject.toml", "requirements.txt", "setup.py", "Pipfile")).alias("py"),
        F.bool_or(F.col("path").contains("docusaurus") | F.col("path").endswith("mkdocs.yml")).alias("site"),
    )
    roots = docs_roots(slim).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs_roots"))
    rows = (
        repositories(slim).join(languages, "repo_id", "left").join(found, "repo_id", "left").join(roots, "repo_id", "left")
        .fillna(0).fillna(False)
    )
    none = P.strings([])
    tools = F.array_distinct(
        F.concat(
            F.coalesce("hints", none),
            F.when(F.col("js"), P.strings(TOOLS_FOR_JS)).otherwise(none),
            F.when(F.col("py"), P.strings(TOOLS_FOR_PYTHON)).otherwise(none),
            F.when(F.col("site") | (F.col("n_docs_roots") > 0), P.strings(TOOLS_FOR_DOCS)).otherwise(none),
        )
    )
    return rows.select(
        "repo_id", F.coalesce("languages", none).alias("languages"), "n_manifests", "n_docs_roots", F.array_sort(tools).alias("tool_hints")
    )


def evidence_gaps(files: DataFrame) -> DataFrame:
    """Missing tests, CI or manifests, for every repository including empty ones."""
    path = F.col("path")
    first = F.substring_index(path, "/", 1)
    flags = files.groupBy("repo_id").agg(
        F.bool_or((first.isin(R.TEST_DIRS)) | path.isin(R.TEST_FILES) | path.startswith(R.WORKFLOW_DIR)).alias("tests"),
        F.bool_or(path.isin(R.CI_FILES) | path.startswith(R.WORKFLOW_DIR)).alias("ci"),
        F.bool_or(
            (~path.rlike(r"(?:^|/)\.[^/]*/") & P.name(path).isin(list(MANIFEST_KIND))) | path.startswith(R.WORKFLOW_DIR)
        ).alias("manifest"),
    )
    return per_repo(
        flags,
        F.when(
            ~F.col("tests"),
            finding(
                "evidence-gap", "high", "high", R.TITLES["no-tests"], None,
                ["no tests/ or common test-runner manifest found"],
            ),
        ),
        F.when(
            ~F.col("ci"),
            finding("evidence-gap", "medium", "medium", R.TITLES["no-ci"], None, ["no common CI config found"]),
        ),
        F.when(
            ~F.col("manifest"),
            finding("scan-blocker", "medium", "medium", R.TITLES["no-manifests"], None, ["no known manifest files found"]),
        ),
    )


def stale_links(broken: DataFrame) -> DataFrame:
    """Findings from the link check; ``line`` and reason come from the broken-link rows."""
    return per_file(
        broken.withColumnRenamed("source", "path"),
        finding(
            "stale-doc-reference", "medium", "high", "Documentation link no longer resolves locally.", F.col("line"),
            F.array(F.concat(F.col("reason"), F.lit(": "), F.col("target"))),
        ),
    )


def detect(files: DataFrame, as_of) -> DataFrame:
    return union_findings(detect_files(files, as_of), evidence_gaps(files))


def removal_gate(found: DataFrame, as_of, repos: DataFrame, strict: bool = False) -> DataFrame:
    """Re-check of finding rows at a date: expired targets, and incomplete marks in strict mode.

    ``repos`` has one row per repository; one without findings passes.
    """
    by_category = F.col("category") == "expired-removal-target"
    expired = by_category | F.coalesce(iso_date(F.col("removal_target")) < F.lit(as_of).cast("date"), F.lit(False))
    marks = F.col("category").isin("deprecated-surface", "compatibility-shim", "marker-gap")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    incomplete = F.lit(strict) & marks & ~by_category & (blank("replacement") | blank("removal_target"))
    counts = found.groupBy("repo_id").agg(
        F.count_if(expired).alias("expired"), F.count_if(incomplete).alias("incomplete")
    )
    every = repos.join(counts, "repo_id", "left").fillna(0)
    return every.withColumn("gate_failed", (F.col("expired") > 0) | (F.col("incomplete") > 0))


def verdict() -> Column:
    return (
        F.when((F.col("critical") > 0) | (F.col("high") >= 2), "not-ready")
        .when((F.col("high") == 1) | (F.col("medium") > 0), "partially-ready")
        .otherwise("ready-for-controlled-deletion")
    )
