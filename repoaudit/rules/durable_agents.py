"""Durable agent rules. Fixed values; conditions are ANSI SQL over the repository signals."""

from __future__ import annotations

from repoaudit.functions.regex import Bank

WORKFLOW_WORDS = ["temporalio.workflow", "@workflow.defn", "@workflow.run", "worker(", "workflow.execute_activity"]
AGENT_WORDS = ["pydantic_ai", "agent(", "temporalagent(", "pydanticaiplugin", "pydanticaiworkflow"]
DOC_WORDS = ["temporal", "pydantic-ai", "pydantic_ai"]
OFFICIAL = {"temporal_agent": "temporalagent(", "plugin": "pydanticaiplugin", "workflow_class": "pydanticaiworkflow"}
HAZARDS = Bank(
    (
        r"\brequests\.(?:get|post|put|patch|delete)\s*\(", r"\bhttpx\.(?:get|post|put|patch|delete)\s*\(",
        r"(?i:\bsubprocess\.)", r"\bopen\s*\(", r"\bdatetime\.now\s*\(", r"\btime\.time\s*\(", r"\buuid\.uuid4\s*\(",
        r"(?i:\brandom\.)",
    )
)
NO_RETRY = "args_validator appears without visible ModelRetry handling"
NO_DEPS_TYPE = "`deps=` appears, but no visible `deps_type=` contract was found"
GOVERNANCE = [".github/CODEOWNERS", "CODEOWNERS"]

HARNESS = "(replay + time_skipping + fake_model)"
OFFICIAL_COUNT = "(CASE WHEN temporal_agent THEN 1 ELSE 0 END + CASE WHEN plugin THEN 1 ELSE 0 END + CASE WHEN workflow_class THEN 1 ELSE 0 END)"
STATES = {
    "workflow-determinism": "CASE WHEN hazards > 0 THEN 'broken' ELSE 'sound' END",
    "sandbox-discipline": "CASE WHEN escapes > 0 THEN 'unsafe' ELSE 'sound' END",
    "durable-agent-path": f"CASE WHEN raw_agents > 0 THEN 'broken' WHEN raw_models > 0 THEN 'unsafe' WHEN {OFFICIAL_COUNT} = 0 THEN 'fragile' ELSE 'sound' END",
    "agent-freeze-drift": f"CASE WHEN {OFFICIAL_COUNT} = 0 THEN 'fragile' ELSE 'sound' END",
    "tool-contracts": "CASE WHEN tool_issues > 0 OR no_retry THEN 'broken' ELSE 'sound' END",
    "dependency-contracts": "CASE WHEN no_deps_type THEN 'unsafe' ELSE 'sound' END",
    "validation-retry-path": "CASE WHEN no_retry THEN 'unsafe' ELSE 'sound' END",
    "verification-harness": f"CASE WHEN {HARNESS} = 0 THEN 'unsafe' WHEN {HARNESS} < 3 THEN 'fragile' ELSE 'hardened' END",
    "doc-grounding": "CASE WHEN wrong_docs > 0 THEN 'fragile' WHEN docs > 0 THEN 'sound' ELSE 'fragile' END",
    "merge-governance": "CASE WHEN governance THEN 'unverified' ELSE 'fragile' END",
}
LEVELS = {
    ("workflow-determinism", "broken"): ("critical", "high"),
    ("workflow-determinism", "sound"): ("low", "medium"),
    ("sandbox-discipline", "unsafe"): ("high", "high"),
    ("sandbox-discipline", "sound"): ("low", "medium"),
    ("durable-agent-path", "broken"): ("critical", "high"),
    ("durable-agent-path", "unsafe"): ("high", "medium"),
    ("durable-agent-path", "fragile"): ("high", "medium"),
    ("durable-agent-path", "sound"): ("low", "medium"),
    ("agent-freeze-drift", "fragile"): ("medium", "low"),
    ("agent-freeze-drift", "sound"): ("low", "low"),
    ("tool-contracts", "broken"): ("high", "high"),
    ("tool-contracts", "sound"): ("low", "medium"),
    ("dependency-contracts", "unsafe"): ("medium", "medium"),
    ("dependency-contracts", "sound"): ("low", "low"),
    ("validation-retry-path", "unsafe"): ("high", "medium"),
    ("validation-retry-path", "sound"): ("low", "low"),
    ("verification-harness", "unsafe"): ("high", "high"),
    ("verification-harness", "fragile"): ("medium", "medium"),
    ("verification-harness", "hardened"): ("low", "medium"),
    ("doc-grounding", "fragile"): ("medium", "high"),
    ("doc-grounding", "sound"): ("low", "low"),
    ("merge-governance", "unverified"): ("medium", "high"),
    ("merge-governance", "fragile"): ("medium", "high"),
}
NO_DOCS_LEVEL = ("low", "low")
TITLES = {
    "workflow-determinism": "Workflow determinism is locally broken",
    "sandbox-discipline": "Sandbox discipline is bypassed",
    "durable-agent-path": "Durable agent path is weaker than the repo claims",
    "agent-freeze-drift": "Durable-agent freeze behavior is not well anchored",
    "tool-contracts": "Tool contracts disagree with Pydantic AI expectations",
    "dependency-contracts": "Dependency contracts look weaker than runtime usage",
    "validation-retry-path": "Validation/retry semantics are not locally proven",
    "verification-harness": "Verification harness is too thin to trust replay safety",
    "doc-grounding": "Docs are missing or teach an unsafe simplification",
    "merge-governance": "Merge governance is still only a local hint",
}
# tool -> gate, severity, confidence, state, title, decision, gate
TOOL_FINDINGS = {
    "ruff": ("tool-contracts", "medium", "high", "Ruff reported Python issues inside the durable surface", "harden", "block-changed-files"),
    "basedpyright": ("dependency-contracts", "medium", "high", "BasedPyright reported Python type contract issues in the durable surface", "harden", "block-changed-files"),
    "semgrep": ("workflow-determinism", "high", "medium", "Semgrep matched workflow or raw-agent hazard patterns", "replace", "block-now"),
}
VERDICT = """CASE WHEN NOT applicable THEN 'not-applicable'
 WHEN workflow_determinism = 'broken' OR durable_agent_path = 'broken' OR sandbox_discipline = 'unsafe' OR tool_contracts = 'broken' THEN 'workflow-time-bomb'
 WHEN durable_agent_path = 'fragile' AND verification_harness IN ('unsafe', 'fragile') THEN 'paper-guardrails'
 WHEN n_weak > 0 THEN 'partially-contained' ELSE 'durable-harness' END"""
