"""From a tree of files to the health of its repositories: audits, their summaries on storage, and the roll-up.

Every audit writes its own partition of the summary table, so audits may run one after the other, at the same time or
again; the roll-up reads one run's partitions and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from repoaudit.operators.facts import python_facts
from repoaudit.operators.findings import severity_counts
from repoaudit.plans import categories, cleanup, domain_drift, error_contract, module_shape, rollup, side_effects, silent_failure
from repoaudit.sources.corpus import repositories, select_surface
from repoaudit.sources.tables import read_summaries, summary_documents, write_summaries
from repoaudit.session import stage

Audit = Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]


def _cleanup(files: DataFrame, as_of: str):
    found = stage(cleanup.detect(files, as_of), "cleanup-findings")
    counts = severity_counts(found, repositories(files))
    return found, counts.select("repo_id", cleanup.verdict().alias("verdict"))


def _domain_drift(files: DataFrame, as_of: str):
    facts = stage(python_facts(select_surface(files, "pythonic-ddd-drift")), "drift-facts")
    return domain_drift.audit(files, facts)


def _category(domain: str) -> Audit:
    return lambda files, as_of: categories.audit(files, domain)[1:]


#: Audits that need nothing beside the files: (files, date) to findings and verdicts.
AUDITS: dict[str, Audit] = {
    "cleanup": _cleanup,
    "distributed-side-effects": lambda files, as_of: side_effects.audit(files),
    "error-governance": lambda files, as_of: error_contract.audit(files),
    "silent-failure": lambda files, as_of: silent_failure.audit(files),
    "module-shape": lambda files, as_of: module_shape.audit(files)[1:],
    "pythonic-ddd-drift": _domain_drift,
    **{d: _category(d) for d in categories.AUDITS},
}


def write_audits(files: DataFrame, domains: Iterable[str], path: str, run_id: str, as_of: str, generated_at: str = "") -> None:
    """Run audits over ``files`` and write their summaries below ``path``, one domain after the other."""
    for domain in domains:
        found, verdicts = AUDITS[domain](files, as_of)
        write_summaries(summary_documents(found, verdicts, domain, run_id, generated_at), path)


def roll_up(spark: SparkSession, path: str, run_id: str, repos: DataFrame, skills: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classified runs, and health, of every repository of ``repos`` from the summaries that one run left at ``path``.

    Repositories without a summary stay, with every domain missing.
    """
    runs = stage(rollup.classify_runs(read_summaries(spark, path, run_id), run_id, repos, skills=skills), "classified-runs")
    return runs, rollup.health(runs)
