"""The way of a summary: audit, record, storage, and back into the roll-up."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from repoaudit.plans import chain, rollup
from repoaudit.rules.catalog import DOMAINS, REQUIRED_SUMMARY_KEYS
from repoaudit.sources import tables
from repoaudit.sources.corpus import read_corpus, repositories, write_archives, write_tree

FOUND = "repo_id string, path string, line int, category string, severity string"


@pytest.fixture
def audited(spark):
    """A function that writes the summary of one domain."""
    verdicts = spark.createDataFrame([("r1", "not-ready"), ("r2", "ready-for-controlled-deletion")], "repo_id string, verdict string")
    found = spark.createDataFrame(
        [("r1", "b.py", 3, "marker-gap", "medium"), ("r1", "a.py", None, "dynamic-entrypoint-risk", "high"), ("r1", "c.py", 1, "marker-gap", "high")],
        FOUND,
    )

    def write(path, domain="cleanup", run="run-1", rows=None, said=None):
        tables.write_summaries(tables.summary_documents(found if rows is None else rows, verdicts if said is None else said, domain, run), path)

    return write


def test_a_record_holds_all_required_keys_and_bounded_findings(spark, tmp_path, audited):
    path = str(tmp_path / "s")
    audited(path)
    back = {r.repo_id: json.loads(r.json) for r in tables.read_summaries(spark, path).collect()}
    assert set(back) == {"r1", "r2"} and all(set(REQUIRED_SUMMARY_KEYS) <= set(d) for d in back.values())
    assert back["r1"]["severity_counts"] == {"critical": 0, "high": 2, "medium": 1, "low": 0}
    assert back["r1"]["findings"] == [
        {"category": "dynamic-entrypoint-risk", "severity": "high", "count": 1, "path": "a.py", "line": 0},
        {"category": "marker-gap", "severity": "high", "count": 2, "path": "b.py", "line": 3},
    ]
    assert (back["r1"]["rollup_bucket"], back["r2"]["rollup_bucket"], back["r2"]["findings"]) == ("red", "green", [])


def test_domains_and_runs_survive_each_other(spark, tmp_path, audited):
    path = str(tmp_path / "s")
    audited(path, run="run-0")
    audited(path)
    side = spark.createDataFrame([("r1", "sound"), ("r3", "unsafe")], "repo_id string, verdict string")
    audited(path, "distributed-side-effects", said=side)
    rows = lambda: {(r.domain, r.run_id, r.repo_id) for r in tables.read_summaries(spark, path).collect()}
    before = {(d, run, r) for d, run, repos in (("cleanup", "run-0", "12"), ("cleanup", "run-1", "12"), ("distributed-side-effects", "run-1", "13")) for r in (f"r{i}" for i in repos)}
    assert rows() == before
    one = spark.createDataFrame([("r9", "not-ready")], "repo_id string, verdict string")
    audited(path, said=one)  # the audit again: its own partition only
    assert rows() == {x for x in before if x[:2] != ("cleanup", "run-1")} | {("cleanup", "run-1", "r9")}


def test_only_the_asked_partitions_are_opened(spark, tmp_path, audited):
    path = str(tmp_path / "s")
    for run in ("run-0", "run-1", "2024"):
        audited(path, run=run)
    read = tables.read_summaries(spark, path, "2024", ["cleanup"])
    assert {r.run_id for r in read.collect()} == {"2024"}
    assert len(read.select(F.col("json")).inputFiles()) >= 1
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "2024" in plan


def test_the_roll_up_takes_what_the_sink_wrote(spark, tmp_path, audited):
    path = str(tmp_path / "s")
    audited(path)
    audited(path, "distributed-side-effects", said=spark.createDataFrame([("r1", "not-applicable")], "repo_id string, verdict string"))
    repos = spark.createDataFrame([("r1",), ("r2",), ("empty",)], "repo_id string")
    runs, health = chain.roll_up(spark, path, "run-1", repos)
    got = {(r.repo_id, r.domain): r for r in runs.collect()}
    assert len(got) == 3 * len(DOMAINS)
    assert {k: r.status for k, r in got.items() if r.status != "missing"} == {
        ("r1", "cleanup"): "present", ("r2", "cleanup"): "present", ("r1", "distributed-side-effects"): "not-applicable",
    }
    assert got["r1", "cleanup"].top_categories == ["marker-gap", "dynamic-entrypoint-risk"]  # two findings before one
    states = {r.repo_id: r.overall_health for r in health.collect()}
    assert states == {"r1": "blocked", "r2": "partial-coverage", "empty": "not-applicable"}
    stale, _ = chain.roll_up(spark, path, "run-2", repos)
    assert {r.status for r in stale.collect()} == {"missing"}


def test_broken_lines_and_newer_records_are_told_apart(spark, tmp_path, audited):
    path = tmp_path / "s"
    audited(str(path))
    place = path / "domain=cleanup" / "run_id=run-1"
    (place / "part-x.txt").write_text('{"repo_id": "r5", "schema_version": 7, "skill": "other"}\nnot json\n[1]\n')
    rows = tables.read_summaries(spark, str(path)).collect()
    assert {(r.repo_id, r.schema_version) for r in rows} == {("r1", 2), ("r2", 2), ("r5", 7), (None, 1)}
    runs, _ = chain.roll_up(spark, str(path), "run-1", spark.createDataFrame([("r5",), ("r1",)], "repo_id string"))
    notes = {r.repo_id: (r.status, r.notes) for r in runs.where("domain = 'cleanup'").collect()}
    assert notes["r5"] == ("invalid", "summary skill mismatch: expected cleanup-audit, got other") and notes["r1"][0] == "present"


def test_records_of_other_tools_count_each_finding_once(spark):
    doc = {k: "x" for k in REQUIRED_SUMMARY_KEYS} | {
        "run_id": "r", "skill": "", "rollup_bucket": "green", "dependency_status": "ready", "bootstrap_actions": [], "dependency_failures": [],
        "severity_counts": dict.fromkeys(("critical", "high", "medium", "low"), 0),
        "findings": [{"category": "a", "count": 9}, {"gate": "b"}, {"kind": "b"}],
    }
    rows = spark.createDataFrame([("q", "cleanup", json.dumps(doc))], "repo_id string, domain string, json string")
    run = rollup.classify_runs(rows, "r", rows).where("domain = 'cleanup'").first()
    assert (run.status, run.top_categories) == ("present", ["b", "a"])


def test_a_written_tree_is_read_back(spark, tmp_path, make_files):
    tree = {"r 1": {"src/a b.py": "x = 1\n", ".github/w.yml": "é: 1\r\n", "empty.py": ""}, "r+2": {"deep/er/%41.md": "text"}}
    files = make_files(tree)
    for _ in range(2):  # a repeated task writes the same bytes
        write_tree(files, str(tmp_path / "t"))
    got = {}
    for r in read_corpus(spark, str(tmp_path / "t")).collect():
        got.setdefault(r.repo_id, {})[r.path] = r.text
    assert got == tree


def test_a_tree_of_summaries_keeps_names(spark, tmp_path):
    rows = [("r 1+%41", "cleanup", "{}"), ("r2", "module-shape", "{\nbroken")]
    df = spark.createDataFrame(rows, "repo_id string, domain string, json string")
    write_tree(df.select("repo_id", F.concat("domain", F.lit("/summary.json")).alias("path"), F.col("json").alias("text")), str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_summary_tree(spark, str(tmp_path / "t")).collect())) == sorted(rows)


def test_summaries_in_archives_keep_names_and_take_no_block_each(spark, tmp_path):
    named = [("r 1+%41", "cleanup", "{}"), ("r2", "module-shape", "{\nbroken"), ("é" * 120, "cleanup", "")]
    rows = named + [(f"c{i}", "cleanup", '{"schema_version": "1.0"}') for i in range(500)]
    df = spark.createDataFrame(rows, "repo_id string, domain string, json string").coalesce(2)
    root = tmp_path / "t"
    for _ in range(2):  # a repeated task replaces its archives
        write_archives(df.select("repo_id", F.concat("domain", F.lit("/summary.json")).alias("path"), F.col("json").alias("text")), str(root))
    assert sorted(map(tuple, tables.read_summary_archives(spark, str(root)).collect())) == sorted(rows)
    files = [p for p in root.rglob("*") if p.is_file()]
    assert len(files) == 2 and sum(p.stat().st_blocks * 512 for p in files) < 40 * len(rows)


def test_summaries_in_archives_are_not_broadcast_by_the_size_of_their_list(spark, tmp_path):
    rows = spark.range(2_000).select(F.format_string("c%04d", "id").alias("repo_id"), F.lit("cleanup/summary.json").alias("path"), F.repeat(F.lit(" "), 10_000).alias("text"))
    write_archives(rows.coalesce(1), str(tmp_path / "t"))
    runs = rollup.classify_runs(tables.read_summary_archives(spark, str(tmp_path / "t")), "r", rows)
    got = runs.where("domain = 'cleanup'").select("repo_id", "status")
    assert sorted(map(tuple, got.collect())) == [(f"c{i:04d}", "invalid") for i in range(2_000)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_audit_of_the_chain_writes_a_present_summary(spark, tmp_path, make_files):
    files = make_files({"r": {"src/a.py": "def f(x):\n    try:\n        return g(x)\n    except Exception:\n        pass\n", "tests/test_a.py": "def test_a():\n    assert 1\n"}, "bare": {"README.md": "# x\n"}})
    path = str(tmp_path / "s")
    chain.write_audits(files, chain.AUDITS, path, "run-1", "2025-01-01", "2025-01-02T00:00:00Z")
    runs, _ = chain.roll_up(spark, path, "run-1", repositories(files))
    rows = runs.collect()
    assert {r.domain for r in rows if r.status != "missing"} == set(chain.AUDITS)
    assert {r.notes for r in rows if r.status == "invalid"} == set()
