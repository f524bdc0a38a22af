"""Roll-up cases: one change per repository against seventeen healthy summaries."""

from __future__ import annotations

import json

import pytest

from repoaudit.plans import rollup as R
from repoaudit.plans import validation as V
from repoaudit.rules import catalog as C

RUN = "run-1"


def summary(domain: str, **change) -> str:
    base = {
        "schema_version": "1.0", "run_id": RUN, "skill": f"{domain}-audit", "domain": domain, "repo_root": "/r", "generated_at": "t",
        "overall_verdict": "ok", "rollup_bucket": "green", "dependency_status": "ready", "bootstrap_actions": [], "dependency_failures": [],
        "severity_counts": {"critical": 0, "high": 0, "medium": 0, "low": 0}, "findings": [], "summary_path": "s", "report_path": "r", "agent_brief_path": "b",
    }
    return json.dumps({**base, **change})


FAILURE = {"name": "tool", "kind": "cli", "required_for": "x", "attempted_command": "c", "failure_reason": "no network", "blocked_by_security": False, "blocked_by_permissions": False, "blocked_by_network": True}
CASES = {
    "healthy": (lambda d: summary(d), "healthy", "complete"),
    "na": (lambda d: summary(d, rollup_bucket="not-applicable"), "not-applicable", "complete"),
    "blocked": (lambda d: summary(d, dependency_status="blocked", dependency_failures=[FAILURE]) if d == "cleanup" else summary(d), "blocked", "complete"),
    "red": (lambda d: summary(d, rollup_bucket="red") if d == "contracts" else summary(d), "blocked", "complete"),
    "missing": (lambda d: None if d == "cleanup" else summary(d), "watch", "partial"),
    "three": (lambda d: None if d in ("cleanup", "contracts", "structure") else summary(d), "partial-coverage", "partial"),
    "broken": (lambda d: "{" if d == "cleanup" else summary(d), "watch", "partial"),
    "yellow": (lambda d: summary(d, rollup_bucket="yellow") if d == "structure" else summary(d), "watch", "complete"),
    "triage": (lambda d: summary(d, rollup_bucket="yellow", overall_verdict="triage") if d == "llm-api-freshness" else summary(d), "watch", "complete"),
    "stale": (lambda d: summary(d, run_id="old") if d == "cleanup" else summary(d), "watch", "partial"),
    "noreport": (lambda d: summary(d), "watch", "partial"),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(c, d, f(d)) for c, (f, _, _) in CASES.items() for d in C.DOMAINS]
    docs = spark.createDataFrame([r for r in rows if r[2] is not None], "repo_id string, domain string, json string")
    arts = [(c, d, k) for c, d, _ in rows for k in ("report", "brief") if not (c == "noreport" and d == "cleanup" and k == "report")]
    repos = spark.createDataFrame([(c,) for c in CASES], "repo_id string")
    return R.classify_runs(docs, RUN, repos, spark.createDataFrame(arts, "repo_id string, domain string, kind string")).cache()


def test_health(runs):
    got = {r.repo_id: (r.overall_health, r.coverage_status) for r in R.health(runs).collect()}
    assert got == {c: (h, s) for c, (_, h, s) in CASES.items()}


def test_notes_and_blanking(runs):
    row = {(r.repo_id, r.domain): r for r in runs.collect()}
    assert row["blocked", "cleanup"].notes == "tool: no network"
    assert row["stale", "cleanup"].notes == "run_id mismatch: expected run-1, got old"
    assert row["noreport", "cleanup"].status == "invalid" and row["noreport", "cleanup"].rollup_bucket == ""
    assert row["missing", "cleanup"].notes == "summary file not found"
    assert row["triage", "llm-api-freshness"].notes.startswith("this run only produced local surface triage")


def test_actions_clusters_and_teaching(runs):
    records = R.domain_records(runs)
    actions = R.ordered_actions(records, R.health(runs)).collect()
    first = {a.repo_id: a for a in actions if a.priority == 1}
    assert first["red"].tier == "now" and first["red"].action == C.HIGH_ACTIONS["contracts"]
    assert first["blocked"].action.startswith("Unblock cleanup-audit first")
    assert "healthy" not in first
    quirk = R.ordered_actions(records, R.health(runs), carry_bucket=False).where("repo_id = 'red'").count()
    assert quirk == 0
    lines = {r.repo_id: r.teaching_line for r in R.teaching_line(R.clusters(records)).collect()}
    assert lines["red"] == C.TEACHING["governance-and-boundaries"] and lines["healthy"] == C.TEACHING_OK
    assert R.unknowns(records).where("kind = 'trust-gap'").count() == 1


def test_every_verdict_has_a_known_bucket():
    from repoaudit.schemas import BUCKETS

    assert set(C.VERDICT_BUCKETS) == set(C.DOMAINS)
    assert all(b in BUCKETS for m in C.VERDICT_BUCKETS.values() for b in m.values())


def test_summary_validation(spark):
    good = summary("cleanup", overall_verdict="not-ready", findings=[{"category": "c", "severity": "low", "confidence": "high", "path": "p", "line": 3}])
    bad = summary("cleanup", overall_verdict="odd", severity_counts={"critical": 0}, findings=[{"category": "c", "line": 0}], categories=[{"id": "x", "state": "clean"}, {"id": "x", "state": "odd"}])
    docs = spark.createDataFrame([("good", "cleanup", good), ("bad", "cleanup", bad), ("junk", "cleanup", "[")], "repo_id string, domain string, json string")
    got = {}
    for r in V.validate_summaries(docs).collect():
        got.setdefault(r.repo_id, set()).add((r.ord, r.json_path))
    assert "good" not in got and got["junk"] == {(0, "summary")}
    assert got["bad"] == {
        (3, "overall_verdict"), (10, "severity_counts.high"), (11, "severity_counts.medium"), (12, "severity_counts.low"), (13, "categories"),
        (22, "findings[0]"), (23, "findings[0]"), (24, "findings[0]"), (25, "findings[0]"), (26, "categories[1]"),
    }


VERSIONS = {"1.0": 1, "2": 3, "2.0": 1, 2: 3, 2.5: 3, "x": 1, None: 1, True: 1}


def test_version_and_list_are_read_once_a_document(spark):
    """An entry of version 2 counts as often as it says; nothing about the document is read again for each entry."""
    entries = [{"category": "a"}, {"category": "a"}, {"category": "b", "count": 3}]
    rows = [(str(i), "cleanup", summary("cleanup", schema_version=v, findings=entries)) for i, v in enumerate(VERSIONS)]
    odd = ["[]", "1", "null", "{", "{}", " {}", "{} x", '"a"', "", None, '{"findings": [1, {"kind": "k"}]}', '{"findings": {}}']
    rows += [(f"odd{i}", "cleanup", t) for i, t in enumerate(odd)]
    parsed = R.parse_summaries(spark.createDataFrame(rows, "repo_id string, domain string, json string"))
    got = {r.repo_id: r for r in parsed.collect()}
    assert [got[str(i)].top_categories[0] for i in range(len(VERSIONS))] == ["b" if n == 3 else "a" for n in VERSIONS.values()]
    assert [got[f"odd{i}"].is_object for i in range(len(odd))] == [t in ("{}", " {}", "{} x", *odd[-2:]) for t in odd]
    assert [got[f"odd{i}"].findings_list for i in range(len(odd))] == [False] * len(odd)
    assert got["odd10"].top_categories == ["k"] and got["0"].findings_list
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    per_entry = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert per_entry and not any("schema_version" in line for line in per_entry)
