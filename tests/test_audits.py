"""Representative repositories with the states and findings they must get."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoaudit.operators.facts import parse_file, python_facts, small_parts
from repoaudit.operators.findings import dedupe, number_within, severity_counts
from repoaudit.operators.links import check_links
from repoaudit.operators.windows import duplicate_stats
from repoaudit.plans import categories, cleanup, domain_drift, module_shape, side_effects, silent_failure, validation
from repoaudit.plans.api_surfaces import alias_table, candidates, collect, detect, surface_rows, surfaces
from repoaudit.sources.corpus import repositories, surface_coverage

NOISE = {".council-runtime/x/site-packages/mod.py": "import os\n# noqa\nassert True\n"}


def states_of(frame, domain):
    st, _, verdicts = categories.audit(frame, domain)
    got = {}
    for r in st.collect():
        got.setdefault(r.repo_id, {})[r.category] = r.state
    return got, {r.repo_id: r.verdict for r in verdicts.collect()}


def test_python_lint(make_files):
    ci = ".github/workflows/ci.yml"
    files = make_files(
        {
            "ruff": {"src/a.py": "x = 1\n", "pyproject.toml": "[tool.ruff]\nline-length = 100\n", ".pre-commit-config.yaml": "- run: ruff check\n", ci: "- run: ruff check .\n- run: ruff format --check .\n", **NOISE},
            "legacy": {"src/a.py": "x = 1\n", "setup.cfg": "[flake8]\nmax-line-length = 100\n", ci: "- run: black --check .\n- run: flake8\n", **NOISE},
            "none": {"README.md": "hello\n", **NOISE},
        }
    )
    states, verdicts = states_of(files, "python-lint-format")
    assert states["ruff"]["toolchain-normalization"] == "hardened"
    assert states["ruff"]["enforcement-gates"] == "hardened"
    assert states["legacy"]["toolchain-normalization"] == "partial"
    assert set(states["none"].values()) == {"not-applicable"}
    assert verdicts == {"ruff": "enforced", "legacy": "partial", "none": "not-applicable"}


def test_security_posture(make_files):
    full = {
        "src/a.py": "x = 1\n", "web/a.ts": "let a = 1\n", "uv.lock": "v\n", "pnpm-lock.yaml": "v\n", "pyproject.toml": "ignore = []\n",
        ".github/workflows/s.yml": "- run: uv sync --frozen\n- run: osv-scanner .\n- run: pnpm audit\n- run: bandit -r src\n",
    }
    files = make_files({"full": full, "nolock": {"src/a.py": "x = 1\n", "pyproject.toml": "index-url = 'x'\n"}})
    states, verdicts = states_of(files, "security-posture")
    assert set(states["full"].values()) == {"enforced"}
    assert states["nolock"]["python-known-vulns"] == "blocked"
    assert verdicts == {"full": "enforced", "nolock": "scan-blocked"}


def test_frontend_and_schema(make_files):
    files = make_files(
        {
            "browser": {"src/a.tsx": "x\n", "e2e/a.ts": "import '@playwright/test'\nawait expect(page).toHaveScreenshot()\nimport { http } from 'msw'\nimport A from '@axe-core/playwright'\n", ".github/workflows/e.yml": "- run: playwright test\n- uses: upload-artifact\n"},
            "jsdom": {"src/a.tsx": "x\n", "vitest.config.ts": "environment: 'jsdom'\n"},
            "gen": {"generated/client/openapi.json": "{}\n"},
        }
    )
    states, verdicts = states_of(files, "frontend-regression")
    assert states["browser"]["browser-fidelity"] == "hardened" and states["jsdom"]["browser-fidelity"] == "partial"
    assert verdicts["browser"] == "enforced" and verdicts["jsdom"] == "partial" and verdicts["gen"] == "not-applicable"
    schema, sv = states_of(files, "schema-governance")
    assert schema["gen"]["source-of-truth-discipline"] == "missing" and sv["gen"] == "partial"


def test_test_quality(make_files):
    good = {"src/a.py": "x\n", "tests/test_a.py": "def test_a():\n    with pytest.raises(ValueError):\n        f()\n", ".github/workflows/t.yml": "- run: pytest\n"}
    files = make_files(
        {
            "clean": {**good, **NOISE},
            "placeholder": {**good, "tests/test_b.py": "def test_b():\n    assert True\n"},
            "mock": {**good, "tests/test_c.py": "@pytest.mark.skip\ndef test_c():\n    mocker.patch('a')\n    mocker.patch('b')\n    mocker.patch('c')\n    mocker.patch('requests.get')\n"},
            "none": {"README.md": "x\n"},
        }
    )
    states, verdicts = states_of(files, "test-quality")
    assert verdicts == {"clean": "clean", "placeholder": "watch", "mock": "watch", "none": "not-applicable"}
    assert states["placeholder"]["placeholder-test-quality"] == "watch"
    assert states["mock"]["mock-discipline"] == "watch" and states["mock"]["skip-retry-governance"] == "watch"


def test_secrets_of_history_by_content(make_files, spark):
    key = "k = AKIA" + "QWERTYUIOPASDFGH\n"
    files = make_files({r: {"a.py": "x = 1\n", ".gitignore": ".env\n*.pem\n*.key\n"} for r in ("gone", "clean", "none")})
    rows = [("gone", f"c{i}", "a.py", key if i < 3 else "x = 1\n") for i in range(5)] + [("clean", "c0", "a.py", "x = 1\n"), ("clean", "c1", "a.py", None)]
    history = spark.createDataFrame(rows, "repo_id string, commit string, path string, text string")
    states = categories.audit(files, "secrets-and-hardcode", history)[0].where("category = 'history-exposure'").collect()
    assert {r.repo_id: r.state for r in states} == {"gone": "watch", "clean": "clean", "none": "watch"}
    commits, blobs = categories.history_content(history)
    assert blobs.count() == 3  # of seven rows
    found = categories.history_exposures(commits, categories.content_hits(blobs), files).collect()
    assert [(r.repo_id, r.path, r.hits, r.line, r.commits) for r in found] == [("gone", "a.py", 1, 1, 3)]
    still = make_files({"gone": {"a.py": key}})
    assert categories.history_exposures(commits, categories.content_hits(blobs), still).count() == 0


def test_secrets_history_is_a_trust_gap(make_files, spark):
    files = make_files({"r": {"a.py": "key = 1\n", ".gitignore": ".env\n*.pem\n*.key\n"}, "leak": {"a.py": 'password = "hunter2hunter2"\ntoken = "${TOKEN}"\n'}})
    states, verdicts = states_of(files, "secrets-and-hardcode")
    assert states["r"]["history-exposure"] == "watch" and states["r"]["ignore-discipline"] == "clean"
    assert states["leak"]["hardcoded-credentials"] == "watch" and states["leak"]["working-tree-exposure"] == "clean"
    history = spark.createDataFrame([("r", "c", "a.py", "x\n")], "repo_id string, commit string, path string, text string")
    assert categories.audit(files, "secrets-and-hardcode", history)[2].where("repo_id = 'r'").first().verdict == "clean"


def test_cleanup_layers(make_files):
    base = {"tests/test_a.py": "x\n", ".github/workflows/c.yml": "x\n"}
    files = make_files(
        {
            "red": {**base, "src/a.py": "importlib.import_module(x)\n", "src/b.py": "# remove-after: 2020-01-01\n"},
            "yellow": {**base, "src/a.py": "feature_flag = 1\n"},
            "green": {**base, "src/legacy/a.py": "x = 1\n"},
        }
    )
    as_of = datetime.date(2024, 1, 1)
    rows = severity_counts(cleanup.detect(files, as_of), repositories(files)).select("repo_id", cleanup.verdict().alias("v"))
    assert {r.repo_id: r.v for r in rows.collect()} == {"red": "not-ready", "yellow": "partially-ready", "green": "ready-for-controlled-deletion"}


def test_side_effect_windows(make_files):
    far = "send(a)\n" + "x\n" * 60 + "session.commit()\n"
    files = make_files(
        {
            "pre": {"a.py": "publish(x)\nsession.commit()\n"},
            "dual": {"a.py": "session.commit()\n\npublish(x)\n"},
            "far": {"a.py": far},
            "out": {"a.py": "session.commit()\nsend(x)\n", "b.py": "outbox\n"},
            "idle": {"a.txt": "nothing\n"},
        }
    )
    found, verdicts = side_effects.audit(files)
    got = {(r.repo_id, r.category, r.line) for r in found.collect() if r.path != "."}
    assert ("pre", "pre-commit-side-effect", 1) in got
    assert {("dual", "dual-write-hazard", 1), ("dual", "outbox-gap", 1)} <= got
    assert not [g for g in got if g[0] == "far"]
    assert ("out", "dual-write-hazard", 1) in got and ("out", "outbox-gap", 1) not in got
    v = {r.repo_id: r.verdict for r in verdicts.collect()}
    assert v["pre"] == "unsafe" and v["idle"] == "not-applicable"


def test_module_shape(make_files):
    big = "".join(f"value_{i} = {i}\n" for i in range(520))
    imports = "".join(f"import lib{i}\n" for i in range(20))
    god = imports + "import fastapi, sqlalchemy, celery, click\n" + big
    tsx = "".join(f"export const v{i} = {i}\n" for i in range(505))
    files = make_files({"bad": {"src/a.py": "def broken(:\n"}, "god": {"src/a.py": god}, "ui": {"src/a.tsx": tsx}, "foreign": {"src/a.py": "x = 1\n", **NOISE}})
    metrics, found, verdicts = module_shape.audit(files)
    v = {r.repo_id: (r.verdict, r.files_scanned) for r in verdicts.collect()}
    assert v["bad"][0] == "scan-blocked" and v["god"][0] == "split-before-merge" and v["foreign"] == ("disciplined", 1)
    cats = {(r.repo_id, r.category) for r in found.collect()}
    assert ("god", "god-module") in cats and ("god", "oversized-file") not in cats
    tags = {r.repo_id: r.tags for r in metrics.collect()}
    assert "ui" in tags["ui"] and "ui" not in tags["god"] and {"http", "db", "worker", "cli"} <= set(tags["god"])


def test_duplicates_match_brute_force(spark):
    rows = [("r", f"f{i}", s, f"d{(i * s) % 7}") for i in range(12) for s in range(1, 4)] + [("r", f"f{i}", 9, "hot") for i in range(9)]
    got = {r.path: (r.duplicate_windows, r.duplicate_partners) for r in duplicate_stats(spark.createDataFrame(rows, "repo_id string, path string, start int, digest string")).collect()}
    by = {}
    for _, p, s, d in rows:
        by.setdefault(d, []).append((p, s))
    want = {}
    for occ in by.values():
        if len(occ) >= 2:
            for p, s in occ:
                w = want.setdefault(p, (set(), set()))
                w[0].add(s)
                w[1].update(q for q, _ in occ if q != p)
    assert got == {p: (len(a), len(b)) for p, (a, b) in want.items()}


def test_numbering_of_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), (F.lit(5000) - F.col("id")).alias("k"))
    rows = number_within(df, "g", ["k"]).collect()
    for g in ("hot", "cold"):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.k)
        assert [r.seq for r in own] == list(range(1, len(own) + 1))


def test_silent_failure(make_files):
    ts = "try { a() } catch (e) { }\nconst s = 'catch (e) { }'\n// @ts-ignore\nlet z = obj!.name\nif (a != b!.c) { }\n"
    files = make_files({"r": {"src/a.ts": ts, "src/b.py": "try:\n    f()\nexcept (ValueError, Exception):\n    pass\n", "api/c.py": "d.get('k')\n"}, "ok": {"src/a.py": "x = 1\n"}})
    found, verdicts = silent_failure.audit(files)
    got = {(r.path, r.category, r.line) for r in found.collect()}
    assert got == {("src/a.ts", "exception-swallow", 1), ("src/a.ts", "type-escape-hatch", 3), ("src/a.ts", "type-escape-hatch", 4), ("src/b.py", "exception-swallow", 3)}
    assert {r.repo_id: r.verdict for r in verdicts.collect()} == {"r": "silent-failure-risk", "ok": "fail-loud"}


def test_domain_drift(make_files):
    files = make_files({"r": {"contexts/a/domain/m.py": "import sqlalchemy\nfrom contexts.b.domain import X\nimport pydantic\n", "main.py": "x = 1\n"}})
    found, verdicts = domain_drift.audit(files, python_facts(files))
    assert {(r.category, r.line) for r in found.collect()} == {("domain-boundary-leak", 1), ("cross-context-model-bleed", 2), ("framework-coupling-signal", 3)}
    assert verdicts.first().verdict == "drifting"


def test_links(make_files):
    doc = "# Top Part\n[a](b.md) [b](gone.md) [c](#top-part) [d](#lost) [e](sub) [f](https://x.y) [g](../../up.md) [h](b.md#nope)\n"
    files = make_files({"r": {"docs/a.md": doc, "docs/b.md": "# B\n", "docs/sub/index.md": "x\n"}})
    got = {(r.target, r.reason, r.line) for r in check_links(files).collect()}
    assert got == {("gone.md", "missing-path", 2), ("#lost", "missing-anchor", 2), ("../../up.md", "missing-path", 2), ("b.md#nope", "missing-anchor", 2)}


def test_api_surfaces(make_files, spark):
    files = make_files(
        {
            "r": {"a.py": "from openai import OpenAI\nx = 'gpt-4o'\nurl = 'https://api.openai.com/v1'\nopenai.ChatCompletion.create(a)\n", "b.py": "import litellm\nbase_url = 1\n", "package.json": '{"dependencies": {"openai": "4"}}'},
            "docs": {"README.md": "from openai import OpenAI\n"},
        }
    )
    ev = collect(files, alias_table(spark))
    resolved = surfaces(candidates(ev), ev)
    got = [(r.repo_id, r.surface_id, r.level, r.surface_provider, r.surface_wrapper, r.confidence) for r in surface_rows(resolved).orderBy("surface").collect()]
    # the family surface joins the provider; the custom one joins the wrapper it shares a file with
    assert got == [("r", "surface-001", "provider-resolved", "openai", "", "high"), ("r", "surface-002", "wrapper-resolved", "", "litellm", "low")]
    assert {(r.surface_id, r.kind) for r in detect(resolved, ev).collect()} == {("surface-002", "gateway-resolution-gap"), ("surface-001", "legacy-suspicion")}


def test_homes_of_classes(spark):
    from repoaudit.plans.api_surfaces import classes, homes

    at = lambda path, n: (path, 1, n, 0)
    rows = [
        ("r", "", "", "custom-http-llm", "family-resolved", at("a", 1)), ("r", "", "", "google-genai", "family-resolved", at("a", 2)),
        ("r", "", "", "anthropic-messages", "family-resolved", at("b", 1)), ("s", "openai", "", "openai-chat", "provider-resolved", at("a", 1)),
        ("s", "", "", "openai-chat", "family-resolved", at("z", 1)), ("s", "", "", "unknown", "ambiguous", at("a", 9)),
    ]
    place = "struct<path: string, late: int, line: int, ord: int>"
    cands = spark.createDataFrame(rows, f"repo_id string, provider string, wrapper string, family string, level string, first {place}")
    ev = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[5][0], r[5][2], i, "code") for i, r in enumerate(rows)],
        "repo_id string, provider string, wrapper string, family string, path string, line int, ord int, source string",
    )
    members = classes(cands)
    family = {(r.repo_id, r["class"]): r.family for r in members.collect()}
    got = {(r.repo_id, family[r.repo_id, r["class"]]): family[r.repo_id, r.home] for r in homes(members, ev).collect()}
    assert got[("r", "custom-http-llm")] == "google-genai" and got[("r", "anthropic-messages")] == "anthropic-messages"
    assert got[("s", "unknown")] == "openai-chat"


def test_foreign_files_are_counted(make_files):
    row = surface_coverage(make_files({"r": {"a.py": "x\n", **NOISE}})).first()
    assert (row.first_party, row.foreign_excluded) == (1, 1)


def test_dedupe_is_idempotent(make_files):
    found = cleanup.detect_files(make_files({"r": {"src/a.py": "# @deprecated\ngetattr(a, b)\n"}}), datetime.date(2024, 1, 1))
    once = dedupe(found)
    key = lambda df: sorted((r.category, r.line) for r in df.collect())
    assert key(once) == key(dedupe(once)) == key(dedupe(found.unionByName(found)))


@pytest.mark.parametrize("text", ["", "\n", "x", "a\r\nb\rc\x0bd e\n", "a\n\n", "\n\n"])
def test_line_split(spark, text):
    from repoaudit.functions.text import line_array

    row = spark.createDataFrame([(text,)], "t string").select(line_array(F.col("t")).alias("l")).first()
    assert row.l == text.splitlines()


def test_deep_source_is_a_parse_error():
    assert parse_file("(" * 5000)["parse_error"]


def test_every_repository_keeps_its_verdict(make_files):
    """A repository that holds nothing of an audit's surface still gets one row."""
    from repoaudit.plans import categories, cleanup, error_contract
    from repoaudit.sources.corpus import repositories

    files = make_files({"empty": {"logo.png": ""}, "old": {"src/a.py": "# @deprecated remove by 2020-01-01\n"}})
    assert {(r.repo_id, r.verdict) for r in error_contract.audit(files)[1].collect()} == {("empty", "not-applicable"), ("old", "not-applicable")}
    found = cleanup.detect_files(files, datetime.date(2024, 1, 1))
    gates = cleanup.removal_gate(found, datetime.date(2024, 1, 1), repositories(files)).collect()
    assert {(r.repo_id, r.gate_failed) for r in gates if r.repo_id == "empty"} == {("empty", False)} and len(gates) == 2
    for audit in ("test-quality", "security-posture"):
        assert {r.repo_id for r in categories.audit(files, audit)[2].collect()} == {"empty", "old"}


def test_no_limits_on_findings(spark, make_files):
    """Nine signals, long lines and many tool details all come out."""
    from repoaudit.operators.tool_runs import merge_tool_runs
    from repoaudit.plans.silent_failure import detect_js

    long_line = "const x" + "y" * 400 + " = a!.b;"
    files = make_files({"r": {"a.ts": "\n".join(["foo(a!.b);"] * 9 + [long_line])}})
    found = [r for r in detect_js(files).collect() if r.title.startswith("Non-null")]
    assert len(found) == 10 and any(r.evidence == [long_line] for r in found)
    runs = spark.createDataFrame(
        [("r", "tach", i, "issues", 1, 1, [f"detail {i}-{j}" for j in range(10)], "") for i in range(5)],
        "repo_id string, tool string, batch int, status string, exit_code int, issue_count int, details array<string>, payload string",
    )
    assert merge_tool_runs(runs).first().details == [f"detail {i}-{j}" for i in range(5) for j in range(10)]


def test_match_mark_in_a_source(make_files):
    from repoaudit.plans.silent_failure import detect_js

    assert detect_js(make_files({"r": {"a.ts": "let \u0001x = 2\n"}})).collect() == []


def test_first_violation_of_a_document_leaves_its_row_alone(spark):
    bad = '{"findings": [' + ", ".join(['{"line": 0}'] * 40) + "]}"
    rows = [("r", "cleanup", bad), ("r", "cleanup", "nothing"), ("s", "cleanup", bad), ("t", "cleanup", None)]
    df = spark.createDataFrame(rows, "repo_id string, domain string, json string")
    keys = ["repo_id", "domain"]
    least = validation.validate_summaries(df, first=True)
    assert least.count() == len(rows)  # one row for each document row, not one for each violation
    want = validation.first_violations(validation.validate_summaries(df), keys).collect()
    assert sorted(validation.first_violations(least, keys).collect()) == sorted(want)


def test_python_facts_leave_the_worker_in_small_parts():
    batch = pa.RecordBatch.from_pydict({"text": ["x = 1"] * 1000})
    sizes = [p.num_rows for p in small_parts(iter([batch, batch.slice(0, 3)]))]
    assert max(sizes) == 64 and sum(sizes) == 1003
