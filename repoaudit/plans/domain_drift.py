"""Domain drift: boundary leaks, cross-context imports, ceremonial classes, tool signals, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.operators.findings import expand, finding, per_file_lists, per_repo, severity_counts, union_findings
from repoaudit.schemas import FINDING
from repoaudit.sources.corpus import select_surface

# fixed values
FORBIDDEN = [
    "fastapi", "flask", "django", "sqlalchemy", "requests", "httpx", "aiohttp", "boto3", "botocore", "redis", "celery",
    "kombu", "aiokafka", "confluent_kafka", "grpc", "pika",
]
SOFT = ["pydantic", "marshmallow"]
FRAMEWORKISH = [
    "adapter", "adapters", "infra", "infrastructure", "api", "routes", "router", "controller", "controllers",
    "persistence", "orm", "sql", "repository", "repositories",
]
COMMAND_NAMES = r"(?:Command|Query|Handler)$"
READ_NAMES = r"(?:Projection|ReadModel|ViewModel)$"
TITLES = {
    "domain-boundary-leak": "Domain code imports framework / infrastructure detail directly",
    "framework-coupling-signal": "Domain code imports a boundary-shaping library directly",
    "cross-context-model-bleed": "One bounded context imports another context's domain model directly",
    "abc-overuse": "Abstract base looks like a nominal interface shell",
    "thin-wrapper": "Class mainly forwards calls and adds almost no policy",
    "anemic-domain-model-signal": "Domain class appears mostly data-shaped with little visible behavior",
    "cqrs-ceremony-signal": "CQRS naming is common but read-model payoff is not obvious",
    "composition-root-gap": "No obvious composition-root / bootstrap file was detected",
}
# tool -> category, severity by issues / failed, confidence, title, gate
TOOLS = {
    "tach": ("boundary-tool-signal", "high", "medium", "medium", "Tach reported Python boundary pressure or could not validate the boundary model cleanly", "block-changed-files"),
    "ruff": ("lint-drift", "medium", None, "high", "Ruff reported Python hygiene issues inside the audited surface", "warn-only"),
    "basedpyright": ("type-contract-drift", "medium", None, "high", "BasedPyright reported Python type contract issues in the audited surface", "warn-only"),
}


def make(category: str, severity: str, confidence: str, line: Column, evidence: Column, gate: str) -> Column:
    return finding(category, severity, confidence, TITLES[category], line, evidence, merge_gate=gate)


def none() -> Column:
    return F.lit(None).cast(FINDING)


def import_findings(path: Column):
    domain, context = P.is_domain_file(path), P.context_name(path)

    def rules(i: Column) -> Column:
        module = i["module"]
        low = F.lower(module)
        top = F.substring_index(module, ".", 1)
        shown = F.array(module)
        leak = top.isin(FORBIDDEN) | F.arrays_overlap(F.split(low, r"\."), P.strings(FRAMEWORKISH))
        foreign = (
            context.isNotNull() & low.contains(".domain") & ~low.contains(F.concat(F.lit("."), context, F.lit(".")))
            & low.contains("contexts.")
        )
        return F.array(
            F.when(domain & leak, make("domain-boundary-leak", "high", "high", i["line"], shown, "block-now"))
            .when(domain & top.isin(SOFT), make("framework-coupling-signal", "medium", "medium", i["line"], shown, "warn-only"))
            .otherwise(none()),
            F.when(domain & foreign, make("cross-context-model-bleed", "high", "high", i["line"], shown, "block-now")).otherwise(none()),
        )

    return rules


def class_findings(path: Column):
    domain = P.is_domain_file(path)

    def rules(c: Column) -> Column:
        shown = F.array(c["name"])
        return F.array(
            F.when(c["shell"], make("abc-overuse", "medium", "high", c["line"], shown, "warn-only")).otherwise(none()),
            F.when(c["thin"], make("thin-wrapper", "medium", "high", c["line"], shown, "warn-only")).otherwise(none()),
            F.when(
                domain & (c["public"] > 0) & (c["nontrivial"] == 0),
                make("anemic-domain-model-signal", "medium", "low", c["line"], shown, "warn-only"),
            ).otherwise(none()),
        )

    return rules


def detect_files(facts: DataFrame) -> DataFrame:
    path = F.col("path")
    return per_file_lists(
        facts,
        F.flatten(F.transform("imports", import_findings(path))),
        F.flatten(F.transform("classes", class_findings(path))),
    )


def repo_counts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Python, domain and entry-point files, and class-name counts, per repository."""
    path = F.col("path")
    src = select_surface(files, "pythonic-ddd-drift").groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("python_files"),
        F.count_if(P.is_domain_file(path)).alias("domain_files"),
        F.count_if(P.is_entrypoint(path)).alias("entrypoints"),
    )
    named = lambda p: F.sum(F.size(F.filter("classes", lambda c: c["name"].rlike(p))))
    names = facts.groupBy("repo_id").agg(named(COMMAND_NAMES).alias("cqrs_names"), named(READ_NAMES).alias("read_models"))
    return files.select("repo_id").distinct().join(src, "repo_id", "left").join(names, "repo_id", "left").fillna(0)


def repo_findings(counts: DataFrame) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    return per_repo(
        counts,
        F.when(
            (F.col("cqrs_names") >= 6) & (F.col("read_models") == 0),
            make(
                "cqrs-ceremony-signal", "medium", "low", F.lit(1),
                F.array(
                    F.concat(F.lit("command/query/handler class count: "), c("cqrs_names")),
                    F.concat(F.lit("read-model clue count: "), c("read_models")),
                ),
                "warn-only",
            ),
        ),
        F.when(
            (F.col("python_files") > 0) & (F.col("entrypoints") == 0),
            make(
                "composition-root-gap", "low", "low", F.lit(1),
                F.array(F.lit("No main.py / app.py / bootstrap.py / container.py clue found")), "warn-only",
            ),
        ),
    )


def tool_findings(merged: DataFrame) -> DataFrame:
    tool, status = F.col("tool"), F.col("status")
    table = lambda i: P.lookup(tool, {k: v[i] for k, v in TOOLS.items() if v[i]})
    counts = (status == "issues") | ((status == "failed") & (tool == "tach"))
    severity = F.when(status == "issues", table(1)).otherwise(table(2))
    shown = F.when(F.size("details") > 0, F.col("details")).otherwise(F.array("summary"))
    body = finding(table(0), severity, table(3), table(4), 1, shown, merge_gate=table(5))
    rows = merged.where(tool.isin(list(TOOLS)) & counts).withColumn("path", F.lit("."))
    return expand(rows, F.array(body))


def verdict_rows(counts: DataFrame, found: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    c = F.col("category")
    kinds = found.groupBy("repo_id").agg(
        F.bool_or(c.isin("domain-boundary-leak", "cross-context-model-bleed", "boundary-tool-signal")).alias("drift"),
        F.count_if(c == "thin-wrapper").alias("thin"),
        F.count_if(c == "abc-overuse").alias("abc"),
    )
    rows = counts.join(severity_counts(found), "repo_id", "left").join(kinds, "repo_id", "left")
    if merged is not None:
        failed = merged.where(F.col("tool").isin(list(TOOLS))).groupBy("repo_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
        rows = rows.join(failed, "repo_id", "left")
    else:
        rows = rows.withColumn("failed", F.lit(False))
    return rows.fillna(0).fillna(False).withColumn(
        "verdict",
        F.when(F.col("python_files") == 0, "not-applicable")
        .when(F.col("failed"), "watch")
        .when(F.col("drift"), "drifting")
        .when((F.col("medium") >= 3) | (F.col("thin") >= 2) | (F.col("abc") >= 2), "ceremonial")
        .when(F.col("total") > 0, "contained")
        .otherwise("disciplined"),
    )


def audit(files: DataFrame, facts: DataFrame, merged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts from parsed facts of the audit's surface."""
    counts = repo_counts(files, facts)
    parts = [detect_files(facts), repo_findings(counts)]
    if merged is not None:
        parts.append(tool_findings(merged))
    found = union_findings(*parts)
    return found, verdict_rows(counts, found, merged)
