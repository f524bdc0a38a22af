"""Reading trees and documents, the sink, and the incremental scan."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from repoaudit.plans.cleanup import detect_files
from repoaudit.sources import tables
from repoaudit.sources.corpus import read_corpus, select_surface
from repoaudit.streaming import run_state as X
from repoaudit.streaming.scan import current_findings, scan_stream

AS_OF = datetime.date(2024, 1, 1)


def test_read_corpus(spark, tmp_path):
    root = tmp_path / "trees"
    for name, data in {
        "r1/src/a.py": b"x = 1\n", "r1/src/__init__.py": b"", "r1/.github/workflows/c.yml": b"a: 1\n", "r1/.git/config.py": b"y\n", "r1/bin.py": b"a\x00b", "r2/deep/er/b.md": "é\n".encode(), "r2/latin.py": b"caf\xe9\n",
        "r2/big.py": b"#" * 2_000_000, "r2/web/a.min.js": b"x\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files = read_corpus(spark, str(root)).cache()
    got = {(r.repo_id, r.path): r.text for r in files.collect()}
    assert got == {("r1", "src/a.py"): "x = 1\n", ("r1", "src/__init__.py"): "", ("r1", ".github/workflows/c.yml"): "a: 1\n", ("r1", ".git/config.py"): "y\n", ("r2", "deep/er/b.md"): "é\n", ("r2", "latin.py"): "café\n", ("r2", "web/a.min.js"): "x\n", ("r2", "big.py"): "#" * 2_000_000}
    assert {r.path for r in select_surface(files, "cleanup").collect()} == {"src/a.py", "src/__init__.py", "deep/er/b.md", "latin.py", "big.py", "web/a.min.js"}
    assert {r.path for r in select_surface(files, "silent-failure").collect()} == {"src/a.py", "src/__init__.py", "latin.py", "big.py"}


def test_lookup_documents(spark, tmp_path):
    hints = tmp_path / "hints.json"
    hints.write_text(json.dumps({"package_aliases": {"OpenAI": {"provider": "openai", "surface_family": "f"}}, "query_seeds": {"openai": ["a", "b"]}}))
    assert tuple(tables.read_aliases(spark, str(hints)).first()) == ("openai", "openai", None, "f", "OpenAI")
    assert tables.read_query_seeds(spark, str(hints)).first().seeds == ["a", "b"]
    contract = tmp_path / "c.json"
    contract.write_text(json.dumps({"skill": "s", "overall_verdicts": ["a"], "rollup_map": {"a": "green"}}))
    assert tuple(tables.read_contracts(spark, str(contract)).first()) == ("s", "a", "green")
    for repo, text in (("r1", "{}"), ("r2", "{\nbad")):
        p = tmp_path / "sum" / repo / "cleanup" / "summary.json"
        p.parent.mkdir(parents=True)
        p.write_text(text)
    got = {(r.repo_id, r.domain): r.json for r in tables.read_summary_tree(spark, str(tmp_path / "sum")).collect()}
    assert got == {("r1", "cleanup"): "{}", ("r2", "cleanup"): "{\nbad"}


def test_incremental_scan_replaces_changed_files(spark, tmp_path, make_files):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    run = lambda: scan_stream(spark, src, sink, lambda f: detect_files(f, AS_OF), cp).awaitTermination()
    make_files({"r": {"a.py": "getattr(a, b)\n", "b.py": "eval(x)\n"}}).write.mode("append").parquet(src)
    run()
    assert {r.path for r in current_findings(spark, sink).collect()} == {"a.py", "b.py"}
    make_files({"r": {"a.py": "clean = 1\n", "c.py": "exec(x)\n"}}).write.mode("append").parquet(src)
    run()
    assert {r.path for r in current_findings(spark, sink).collect()} == {"b.py", "c.py"}


def test_only_given_fields_overwrite(spark):
    rows = [("r", "d", 1, "running", "a", None), ("r", "d", 2, None, "b", None), ("r", "d", 3, "complete", None, None)]
    ev = spark.createDataFrame(rows, "run_id string, domain string, seq long, runtime_status string, detail string, notes string")
    ev = ev.withColumn("child_verdict", F.lit(None).cast("string")).withColumn("summary_path", F.lit(None).cast("string"))
    r = X.latest_fields(ev).first()
    assert (r.runtime_status, r.detail, r.notes, r.last_seq) == ("complete", "b", None, 3)


def test_missing_artifact_invalidates_a_finished_worker(spark):
    row = {
        "run_id": "run-7", "domain": "cleanup", "expected_skill": "cleanup-audit", "skill": "cleanup-audit", "stage": "complete", "dependency_status": "ready",
        "current_action": "", "actions_list": True, "failures_list": True, "keys": X.REQUIRED, "summary_path": "s", "report_path": "r", "agent_brief_path": "b",
    }
    rec = spark.createDataFrame([row])
    have = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert X.sync_runtime(rec, "run-7", have("s", "r", "b")).first().runtime_status == "complete"
    bad = X.sync_runtime(rec, "run-7", have("s", "b")).first()
    assert (bad.runtime_status, bad.detail) == ("invalid", "report artifact missing at r")
