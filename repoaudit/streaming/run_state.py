"""Run state from update records: batch twins and keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repoaudit.functions.paths import lookup, strings
from repoaudit.rules.catalog import DOMAINS
from repoaudit.schemas import DEPENDENCY_STATUSES

# fixed values
FINAL = ["complete", "blocked", "invalid", "missing", "not-applicable"]
STAGES = {
    "preflight": "Running runtime preflight.",
    "bootstrapping": "Installing missing dependencies.",
    "running": "Audit is running.",
    "not-applicable": "Domain is not applicable.",
    "complete": "Audit completed.",
    "invalid": "Runtime sidecar failed validation.",
}
BLOCKED_DETAIL = "Dependency bootstrap blocked the worker."
WAITING_DETAIL = "Not started yet"
ARTIFACT_STAGES = ["complete", "blocked", "not-applicable"]
ARTIFACTS = [("summary", "summary_path"), ("report", "report_path"), ("agent-brief", "agent_brief_path")]
REQUIRED = [
    "schema_version", "run_id", "skill", "domain", "repo_root", "generated_at", "stage", "dependency_status", "current_action",
    "bootstrap_actions", "dependency_failures", "summary_path", "report_path", "agent_brief_path",
]
STAGE_PROGRESS = {"reset-harness": 0.10, "spawning": 0.20, "collecting": 0.90, "aggregating": 1.00, "done": 1.00}
STAGE_LABELS = {
    "reset-harness": "RESETTING HARNESS", "spawning": "SPAWNING SUBAGENTS", "running": "RUNNING (Audits Active)",
    "collecting": "COLLECTING ARTIFACTS", "aggregating": "AGGREGATING REPORTS", "done": "COMPLETE",
}
STAGE_TONES = {
    "reset-harness": "running", "spawning": "running", "running": "running", "collecting": "watch", "aggregating": "watch",
    "done": "healthy",
}
# worker fields an update record may carry; only given ones overwrite
FIELDS = ["runtime_status", "detail", "notes", "child_verdict", "summary_path"]


def reject_stale(events: DataFrame, run_id: str) -> DataFrame:
    """Records of another run are not merged."""
    return events.where(F.col("run_id") == run_id)


def latest_fields(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Batch state per (run_id, domain): the last given value of every field, by ``seq``.

    ``max_by`` ignores records that do not carry the field; the aggregation combines map-side.
    """
    fields = fields or FIELDS
    given = lambda f: F.when(F.col(f).isNotNull(), F.col("seq"))
    return events.groupBy("run_id", "domain").agg(
        *[F.max_by(f, given(f)).alias(f) for f in fields], F.max("seq").alias("last_seq")
    )


def worker_status(stage: Column, dependency_status: Column) -> Column:
    known = [s for s in STAGES]
    return (
        F.when((dependency_status == "blocked") | (stage == "blocked"), "blocked")
        .when(stage.isin(known), stage)
        .otherwise("waiting")
    )


def sync_runtime(records: DataFrame, run_id: str, artifacts: DataFrame | None = None) -> DataFrame:
    """Worker status from runtime records (one per domain): shape, identity, artifacts, then stage.

    ``records`` carries ``keys`` (the JSON keys present) and the record fields. ``artifacts``
    lists existing artifact paths.
    """
    missing_keys = F.array_sort(F.array_except(strings(REQUIRED), F.col("keys")))
    text = lambda c: F.coalesce(c, F.lit(""))
    dep = text("dependency_status")
    shape = (
        F.when(F.size(missing_keys) > 0, F.concat(F.lit("runtime missing required keys: ['"), F.array_join(missing_keys, "', '"), F.lit("']")))
        .when(~F.col("actions_list"), "runtime bootstrap_actions must be a list")
        .when(~F.col("failures_list"), "runtime dependency_failures must be a list")
        .when(~dep.isin(DEPENDENCY_STATUSES), F.concat(F.lit("runtime dependency_status invalid: "), F.coalesce(F.nullif(dep, F.lit("")), F.lit("-"))))
    )
    identity = F.when(
        text("run_id") != run_id, F.concat(F.lit(f"run_id mismatch: expected {run_id}, got "), F.coalesce(F.nullif(text("run_id"), F.lit("")), F.lit("-")))
    ).when(
        (text("skill") != "") & (text("skill") != F.col("expected_skill")),
        F.concat(F.lit("skill mismatch: expected "), F.col("expected_skill"), F.lit(", got "), F.col("skill")),
    )
    rows = records.withColumn("fault", F.coalesce(shape, identity))
    for label, col in ARTIFACTS:
        flag = f"_has_{col}"
        if artifacts is None:
            rows = rows.withColumn(flag, F.lit(True))
        else:
            # several records may name one path: distinct paths keep the row count
            known = artifacts.select(F.col("path").alias(col)).distinct().withColumn(flag, F.lit(True))
            rows = rows.join(known, col, "left").fillna(False, [flag])
    lost = F.array_compact(
        F.array(
            *[
                F.when(text(col) == "", F.lit(f"{label} path missing")).when(
                    ~F.col(f"_has_{col}"), F.concat(F.lit(f"{label} artifact missing at "), F.col(col))
                )
                for label, col in ARTIFACTS
            ]
        )
    )
    final = F.col("stage").isin(ARTIFACT_STAGES)
    gap = F.when(final & (F.size(lost) > 0), F.array_join(lost, "; "))
    status = worker_status(F.col("stage"), dep)
    default = F.when(status == "blocked", BLOCKED_DETAIL).when(status == "waiting", WAITING_DETAIL).otherwise(lookup(status, STAGES))
    detail = F.coalesce(F.nullif(text("current_action"), F.lit("")), default)
    bad = F.coalesce("fault", gap)
    return rows.select(
        "run_id", "domain",
        F.when(bad.isNotNull(), "invalid").otherwise(status).alias("runtime_status"),
        F.coalesce(bad, detail).alias("detail"),
    )


def progress(workers: DataFrame, stage: str = "running") -> DataFrame:
    """Completion and clamped progress per run."""
    done = F.avg(F.col("runtime_status").isin(FINAL).cast("double"))
    ratio = F.least(F.greatest(F.lit(0.20) + done * 0.60, F.lit(0.0)), F.lit(1.0)) if stage == "running" else F.lit(STAGE_PROGRESS[stage])
    return workers.groupBy("run_id").agg(
        done.alias("completion"), ratio.alias("progress"), F.first(F.lit(stage)).alias("stage")
    ).select(
        "run_id", "completion", "progress", "stage",
        lookup(F.col("stage"), STAGE_LABELS).alias("state_label"), lookup(F.col("stage"), STAGE_TONES).alias("state_tone"),
    )


STATE = "run_id string, domain string, " + ", ".join(f"{f} string" for f in FIELDS) + ", last_seq bigint"
KEPT = ", ".join(f"{f} string, {f}_seq bigint" for f in FIELDS) + ", last_seq bigint"


def fold_updates(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge the records of one (run, domain) into its state; late records lose to newer ones per field."""
    kept = list(state.get) if state.exists else [None, -1] * len(FIELDS) + [-1]
    for batch in batches:
        for i, field in enumerate(FIELDS):
            given = batch[batch[field].notna()]
            if len(given):
                top = given.loc[given["seq"].idxmax()]
                if top["seq"] > kept[2 * i + 1]:
                    kept[2 * i], kept[2 * i + 1] = top[field], int(top["seq"])
        kept[-1] = max(kept[-1], int(batch["seq"].max()))
    state.update(tuple(kept))
    yield pd.DataFrame([[*key, *kept[0:-1:2], kept[-1]]], columns=["run_id", "domain", *FIELDS, "last_seq"])


def worker_state(events: DataFrame) -> DataFrame:
    """Streaming state per (run_id, domain): one small record, whatever the number of updates."""
    return events.groupBy("run_id", "domain").applyInPandasWithState(
        fold_updates, STATE, KEPT, "update", GroupStateTimeout.NoTimeout
    )


def initial_workers(runs: DataFrame) -> DataFrame:
    """Every catalog domain of every run, waiting."""
    return runs.select("run_id").distinct().select("run_id", F.explode(strings(list(DOMAINS))).alias("domain")).withColumn("runtime_status", F.lit("waiting"))
