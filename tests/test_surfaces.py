"""Surfaces: merging to a fixpoint, rules as a table, document evidence at a date."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from repoaudit.operators import rule_index
from repoaudit.plans import api_surfaces as A
from repoaudit.sources import tables


def surfaces_of(files, **given):
    ev = A.collect(files, **given)
    rows = A.surface_rows(A.surfaces(A.candidates(ev), ev)).collect()
    return sorted((r.repo_id, r.level, r.surface_family, r.surface_provider, r.surface_wrapper) for r in rows)


def test_a_merge_that_only_an_earlier_merge_makes_possible(make_files):
    """The custom surface shares no file with the provider, but one with the family surface that joins the provider first."""
    tree = {"a.py": "from openai import OpenAI\n", "b.py": "x = 'gpt-4o'\nbase_url = 1\n"}
    alone = {"a.py": "from openai import OpenAI\n", "b.py": "base_url = 1\n"}
    got = surfaces_of(make_files({"r": tree, "s": alone}))
    assert got == [
        ("r", "provider-resolved", "openai-compatible", "openai", ""),
        ("s", "family-resolved", "custom-http-llm", "", ""), ("s", "provider-resolved", "openai-compatible", "openai", ""),
    ]


def test_a_generic_wrapper_is_open_until_it_has_a_family(make_files):
    tree = {"a.py": "import litellm\n", "b.py": "x = 'gpt-4o'\n", "c.py": "y = 'gemini-1.5'\n"}
    assert surfaces_of(make_files({"r": tree})) == [
        ("r", "family-resolved", "google-genai", "", ""), ("r", "wrapper-resolved", "openai-compatible", "", "litellm"),
    ]


def by_hand(classes, shared):
    """Homes of one repository's (level, family) classes, merged one at a time until nothing changes."""
    state = [{"family": f, "members": {i}, "home": i} for i, (_, f) in enumerate(classes)]
    alive = list(range(len(classes)))
    vague = ("unknown", "generic-wrapper", "custom-http-llm")
    meets = lambda s, t: any(frozenset((s, m)) in shared for m in state[t]["members"])

    def merge(s, t):
        if state[t]["family"] in vague and state[s]["family"] not in vague:
            state[t]["family"] = state[s]["family"]
        state[t]["members"] |= state[s]["members"]
        state[s]["home"] = t
        alive.remove(s)

    while True:
        step = next(
            (
                (s, t)
                for s in alive
                for t in alive
                if classes[s][0] in A.WEAK and classes[t][0] in A.FIRM
                and (state[t]["family"] in (classes[s][1], "generic-wrapper") or classes[s][1] in A.LOOSE and meets(s, t))
            ),
            None,
        )
        if step is None:
            break
        merge(*step)
    for s in [s for s in alive if classes[s] == ("family-resolved", "custom-http-llm")]:
        t = next((t for t in alive if t != s and classes[t][0] == "family-resolved" and classes[t][1] not in A.LOOSE and meets(s, t)), None)
        if t is not None:
            merge(s, t)
    return [x["home"] for x in state]


def test_homes_against_merging_by_hand(spark):
    """Many small repositories of random classes and shared files."""
    import random

    rng = random.Random(11)
    kinds = [
        ("openai", "", "openai-compatible", "provider-resolved"), ("gemini", "", "google-genai", "provider-resolved"),
        ("", "litellm", "generic-wrapper", "wrapper-resolved"), ("", "langchain", "generic-wrapper", "wrapper-resolved"),
        ("", "", "openai-compatible", "family-resolved"), ("", "", "google-genai", "family-resolved"),
        ("", "", "anthropic-messages", "family-resolved"), ("", "", "custom-http-llm", "family-resolved"), ("", "", "unknown", "ambiguous"),
    ]
    cands, ev, want = [], [], {}
    for n in range(60):
        own = rng.sample(kinds, rng.randint(2, 8))
        files = [sorted({f"f{rng.randint(0, 4)}" for _ in range(rng.randint(1, 2))}) for _ in own]
        for i, (p, w, f, level) in enumerate(own):
            cands.append((f"r{n}", p, w, f, level, ("a", 1, i, 0)))
            ev += [(f"r{n}", p, w, f, path, i, 0, "code") for path in files[i]]
        shared = {frozenset((i, j)) for i in range(len(own)) for j in range(i) if set(files[i]) & set(files[j])}
        want[f"r{n}"] = [h + 1 for h in by_hand([(k[3], k[2]) for k in own], shared)]
    place = "struct<path: string, late: int, line: int, ord: int>"
    members = A.classes(spark.createDataFrame(cands, f"repo_id string, provider string, wrapper string, family string, level string, first {place}"))
    evidence = spark.createDataFrame(ev, "repo_id string, provider string, wrapper string, family string, path string, line int, ord int, source string")
    got = {}
    for r in A.homes(members, evidence).orderBy("repo_id", "class").collect():
        got.setdefault(r.repo_id, []).append(r.home)
    assert got == want
    assert any(h != i for hs in want.values() for i, h in enumerate(hs, 1))


def test_a_row_added_to_the_rules_gives_findings(spark, make_files, tmp_path):
    tree = {"a.py": "client = AcmeLLM(key)\nAZURE_OPENAI_API_KEY OPENAI_API_KEY\n", "b.md": "acmellm( and ACMELLM (\n"}
    rules = A.rule_table(spark)
    own = spark.createDataFrame([(900, "acme", r"(?i:\bacmellm\s*\()", "provider-sdk", "strong", "acme", None, "acme-chat", "acme", False, None)], rules.schema)
    rules.unionByName(own).write.json(str(tmp_path / "rules"))
    ev = A.table_evidence(make_files({"r": tree}), tables.read_rules(spark, str(tmp_path / "rules")))
    got = sorted((r.path, r.line, r.label, r.strength, r.provider) for r in ev.collect())
    assert got == [
        ("a.py", 1, "acme", "strong", "acme"), ("a.py", 2, "azure-openai-host", "strong", "azure-openai"),
        ("a.py", 2, "env-AZURE_OPENAI_API_KEY", "strong", "azure-openai"), ("a.py", 2, "env-OPENAI_API_KEY", "strong", "openai"),
        ("b.md", 1, "acme", "weak", "acme"),
    ]
    assert surfaces_of(make_files({"r": tree}), rules=rules.unionByName(own))[0][3] in ("acme", "azure-openai")


def test_tables_of_rules_and_built_in_rules_agree(spark, make_files):
    text = "from openai import OpenAI\nMyChatOpenAIx = 'gpt-4o gpt-4'\nurl = 'https://api.openai.com/v1/chat/completions'\n# anthropic-version ſ\ncontents = 1; llm_gateway\n"
    files = make_files({"r": {"a.py": text, "b.ts": "// createOpenAI\ncreateOpenAI()\n", "c.md": text, "d.py": ""}})
    order = ["path", "line", "label", "snippet", "strength", "source", "model_hint", "base_url_hint", "ord"]
    rows = lambda df: sorted((tuple(str(x) for x in r) for r in df.select(*order).collect()))
    assert rows(A.table_evidence(files, A.rule_table(spark))) == rows(A.line_evidence(files))


def test_rules_that_cannot_be_indexed_are_refused(spark, make_files):
    rules = A.rule_table(spark).limit(1)
    bad = [(901, "any-word", r"\w+", "env", "weak", None, None, "f", "s", False, None), (902, "marks", r"::=", "env", "weak", None, None, "f", "s", False, None)]
    with pytest.raises(ValueError, match=r"\['any-word', 'marks'\]"):
        rule_index.matched_lines(make_files({"r": {"a.py": "x"}}), rules.unionByName(spark.createDataFrame(bad, rules.schema)))
    with pytest.raises(ValueError, match="more than once"):
        rule_index.matched_lines(make_files({"r": {"a.py": "x"}}), rules.unionAll(rules))


def test_aliases_of_a_document_name_packages(spark, make_files, tmp_path):
    hints = tmp_path / "hints.json"
    hints.write_text(json.dumps({"package_aliases": {"Acme-LLM": {"provider": "acme", "surface_family": "acme-chat"}}}))
    files = make_files({"r": {"package.json": '{"dependencies": {"acme-llm": "1.2"}}'}})
    assert surfaces_of(files, aliases=tables.read_aliases(spark, str(hints))) == [("r", "provider-resolved", "acme-chat", "acme", "")]


def test_evidence_holds_for_a_time_and_for_surfaces_that_exist(spark):
    day = lambda n: datetime.date(2024, 12, 31) - datetime.timedelta(n)
    rows = [
        ("old", "surface-001", "l", "s", "verified", day(200)), ("new", "surface-001", "l", "s", "verified", day(3)),
        ("late", "surface-001", "l", "s", "verified", day(-5)), ("none", "surface-009", "l", "s", "verified", day(3)),
        ("back", "surface-001", "l", "s", "verified", day(9)), ("back", "surface-001", "l", "s", "failed", day(2)),
        ("same", "surface-001", "l", "s", "verified", day(2)), ("same", "surface-001", "l", "s", "failed", day(2)),
        ("other", "surface-001", "l", "s", "failed", day(2)), ("other", "surface-001", "l", "t", "verified", day(8)),
        ("bare", "surface-001", "l", "s", "verified", day(3)), ("blank", "surface-001", "l", "s", "verified", None),
    ]
    evidence = spark.createDataFrame(rows, "repo_id string, surface_id string, library_id string, source_ref string, status string, checked_at date")
    held = A.evidence_as_of(evidence, "2024-12-31", 90)
    repos = sorted({r[0] for r in rows})
    own = spark.createDataFrame([(r, "surface-001") for r in repos if r != "bare"], "repo_id string, surface_id string")
    verdicts = spark.createDataFrame([(r, "not-applicable" if r == "bare" else "triage") for r in repos], "repo_id string, verdict string")
    got = {r.repo_id: r.verdict for r in A.verified_verdicts(verdicts, held, own).collect()}
    assert {k for k, v in got.items() if v == "verified"} == {"new", "other"} and got["bare"] == "not-applicable"
    assert {r.repo_id for r in A.unknown_surfaces(held, own).collect()} == {"none", "bare"}
    assert A.evidence_as_of(evidence, "2024-12-31").where(F.col("repo_id") == "old").count() == 1
