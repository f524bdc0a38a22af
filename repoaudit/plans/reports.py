"""Report rows and fixed texts per verdict and category: selection only, no layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.paths import lookup
from repoaudit.operators.findings import top_findings

# fixed values: condition categories -> action text, in order; the last text stands when none applies
ACTIONS = {
    "error-governance": (
        [
            (["universal-problem-gap", "field-pattern-gap", "http-mapping-gap"], "Extract one shared public error schema and align HTTP responses on `application/problem+json` plus stable top-level fields."),
            (["text-branching", "numeric-or-vague-code", "ssot-missing"], "Replace message-text branching with one versioned error-code catalog and structured `code` handling."),
            (["leakage-risk", "no-global-handler", "traceability-gap"], "Add one outward-facing boundary translator that strips internals and injects traceability fields consistently."),
            (["codegen-drift", "ci-gate-missing"], "Generate Python / TypeScript error artifacts from the same source of truth and add drift checks in CI."),
            (["async-contract-gap"], "Make async error payloads structurally explicit instead of relying on plain strings or implicit failure semantics."),
        ],
        "Keep the current error contract explicit and resist reintroducing ad-hoc JSON error shapes.",
    ),
    "module-shape": (
        [
            (["hub-module"], "Narrow import-heavy hub modules so fewer unrelated changes keep converging on the same file."),
            (["export-surface-sprawl"], "Reduce public surfaces and stop using one module as the default import bucket."),
            (["duplication-cluster"], "Deduplicate repeated control flow only after identifying a stable shared abstraction."),
        ],
        None,
    ),
    "structure": (
        [
            (["architecture-violation", "cycle"], "Remove live boundary leaks and cycles before tightening merge gates."),
            (["unused-file", "unused-dependency", "unused-export"], "Quarantine and validate dead-code candidates before deleting them."),
        ],
        "Keep the locked toolchain green before raising merge strictness.",
    ),
}
SUMMARY_LINES = {
    "cleanup/not-ready": "The repository still contains high-signal cleanup blockers or stale references that should be resolved before calling removal work ready.",
    "cleanup/partially-ready": "The repository shows cleanup debt and validation gaps, but not enough evidence for a top-level removal blocker.",
    "cleanup/ready-for-controlled-deletion": "No cleanup blockers or stale-surface signals were detected by the locked audit stack.",
    "distributed-side-effects/not-applicable": "No meaningful broker / webhook / worker / distributed side-effect surface was detected.",
    "distributed-side-effects/unsafe": "The repo contains strong evidence that distributed side effects can duplicate, disappear, or diverge.",
    "distributed-side-effects/fragile": "The repo shows distributed side-effect weaknesses that are likely survivable in demos and dangerous in production.",
    "distributed-side-effects/watch": "The repo shows limited or moderate reliability debt, but not enough evidence for a top-level unsafe verdict.",
    "distributed-side-effects/hardened": "The repo shows multiple visible reliability controls and no scanner-detected high-signal hazards.",
    "distributed-side-effects/sound": "No high-signal distributed side-effect hazards were found by the heuristic scan.",
    "pythonic-ddd-drift/not-applicable": "No Python files were detected.",
    "pythonic-ddd-drift/watch": "The locked Python toolchain did not complete cleanly, so boundary drift evidence is incomplete.",
    "pythonic-ddd-drift/drifting": "The repo shows real boundary drift, not just stylistic preferences.",
    "pythonic-ddd-drift/ceremonial": "The repo is accumulating Python-unfriendly abstraction ceremony faster than it is preserving useful boundaries.",
    "pythonic-ddd-drift/contained": "The repo shows some architecture drift, but the damage still looks locally repairable.",
    "pythonic-ddd-drift/disciplined": "No strong Pythonic / DDD drift signals were found by the locked scan.",
    "module-shape/sprawling": "Module shape debt is spreading across several hotspots and should stop normalizing.",
    "module-shape/contained": "The repo has visible module-shape debt, but it still looks recoverable without major surgery.",
    "module-shape/disciplined": "No major giant-file or god-module pressure was detected by the baseline scan.",
}


def summary_line(domain: Column, verdict: Column) -> Column:
    return lookup(F.concat_ws("/", domain, verdict), SUMMARY_LINES)


def actions(found: DataFrame, domain: str, n: int = 3) -> DataFrame:
    """First ``n`` action texts per repository from the categories present."""
    steps, default = ACTIONS[domain]
    flags = found.groupBy("repo_id").agg(
        *[F.bool_or(F.col("category").isin(cats)).alias(f"_{i}") for i, (cats, _) in enumerate(steps)]
    )
    texts = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(t)) for i, (_, t) in enumerate(steps)]))
    if default:
        texts = F.when(F.size(texts) == 0, F.array(F.lit(default))).otherwise(texts)
    return flags.select("repo_id", F.slice(texts, 1, n).alias("actions"))


def report_rows(found: DataFrame, section: str, n: int) -> DataFrame:
    """``(section, ord, text)`` rows of the worst findings of each repository."""
    text = F.concat_ws(" | ", F.col("severity"), F.col("category"), F.concat_ws(":", "path", F.coalesce("line", F.lit(0)).cast("string")), F.col("title"))
    return top_findings(found, n).select("repo_id", F.lit(section).alias("section"), F.col("rank").alias("ord"), text.alias("text"))
