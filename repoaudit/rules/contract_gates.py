"""Signature contract gates. Fixed values; conditions are ANSI SQL over the repository signals."""

from __future__ import annotations

SURFACE_NAMES = ["openapi", "schema", "contract", "graphql"]
SURFACE_WORDS = ["basemodel", "typeddict", "annotated[", "zod.object", "jsonschema", "marshmallow", "pydantic"]
SCHEMA_WORDS = ["openapi", "graphql", "json schema", "response_model", "schema_extra", "zod."]
RUNTIME_WORDS = ["pydantic", "zod", "jsonschema.validate", "marshmallow", "schema.validate", "response_model"]
PACKAGE_RUNTIME_WORDS = ["zod", "valibot", "io-ts", "joi"]
ERROR_WORDS = ["result[", "either[", "problem+json", "error_code", "errorcode", "typed error", "failure_reason"]
ESCAPES = ["# type: ignore", "@ts-ignore", "@ts-nocheck", "eslint-disable", "noqa"]
TEST_WORDS = ["hypothesis", "schemathesis", "contract", "openapi", "schema"]
CODEOWNERS = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]

JS = "(l_typescript OR l_javascript)"
STATES = {
    "contract-surface": "CASE WHEN n_surface = 0 THEN 'missing' WHEN n_surface < 3 THEN 'partial' ELSE 'enforced' END",
    "compile-time-gates": f"CASE WHEN l_python AND python_strict AND (NOT {JS} OR typed_lint OR ts_strict) THEN 'enforced' WHEN python_strict OR ts_strict OR typed_lint THEN 'partial' WHEN n_workflows > 0 THEN 'theater' ELSE 'missing' END",
    "runtime-boundary-validation": "CASE WHEN runtime_schema THEN 'partial' ELSE 'missing' END",
    "error-contract": "CASE WHEN error_contract THEN 'partial' ELSE 'missing' END",
    "escape-hatch-governance": "CASE WHEN escape_hatches >= 8 THEN 'theater' WHEN escape_hatches >= 2 THEN 'partial' ELSE 'enforced' END",
    "architecture-boundaries": "CASE WHEN architecture_config AND n_workflows > 0 THEN 'enforced' WHEN architecture_config THEN 'theater' ELSE 'missing' END",
    "contract-tests": "CASE WHEN contract_tests THEN 'partial' ELSE 'missing' END",
    "merge-governance": "CASE WHEN n_workflows > 0 OR codeowners THEN 'unverified' ELSE 'missing' END",
}
# (gate, state) -> severity, confidence
LEVELS = {
    ("contract-surface", "missing"): ("high", "high"),
    ("contract-surface", "partial"): ("medium", "medium"),
    ("contract-surface", "enforced"): ("low", "medium"),
    ("compile-time-gates", "enforced"): ("low", "medium"),
    ("compile-time-gates", "partial"): ("medium", "medium"),
    ("compile-time-gates", "theater"): ("high", "medium"),
    ("compile-time-gates", "missing"): ("high", "high"),
    ("runtime-boundary-validation", "partial"): ("medium", "medium"),
    ("runtime-boundary-validation", "missing"): ("high", "high"),
    ("error-contract", "partial"): ("medium", "medium"),
    ("error-contract", "missing"): ("medium", "medium"),
    ("escape-hatch-governance", "theater"): ("high", "high"),
    ("escape-hatch-governance", "partial"): ("medium", "medium"),
    ("escape-hatch-governance", "enforced"): ("low", "low"),
    ("architecture-boundaries", "enforced"): ("low", "medium"),
    ("architecture-boundaries", "theater"): ("medium", "medium"),
    ("architecture-boundaries", "missing"): ("medium", "high"),
    ("contract-tests", "partial"): ("medium", "medium"),
    ("contract-tests", "missing"): ("medium", "medium"),
    ("merge-governance", "unverified"): ("medium", "high"),
    ("merge-governance", "missing"): ("medium", "high"),
}
TITLES = {
    "contract-surface": "Contract surface is too thin or missing",
    "compile-time-gates": "Compile-time gates are softer than the repo claims",
    "runtime-boundary-validation": "Runtime boundary validation is not visibly guarding ingress/egress",
    "error-contract": "Failure paths are not modeled as a stable contract",
    "escape-hatch-governance": "Escape hatches are easier to use than the rules imply",
    "architecture-boundaries": "Boundary governance is missing or decorative",
    "contract-tests": "Contract tests are missing or too weak to trust",
    "merge-governance": "Merge governance exists only as a local hint",
}
STATE_PRIORITY = {"missing": 0, "theater": 1, "partial": 2, "unverified": 3, "enforced": 4, "hardened": 5}
# over one column per gate, dashes replaced
VERDICT = """CASE WHEN contract_surface IN ('missing', 'theater') AND runtime_boundary_validation = 'missing' THEN 'contract-theater'
 WHEN compile_time_gates IN ('missing', 'theater') OR runtime_boundary_validation IN ('missing', 'theater') OR architecture_boundaries IN ('missing', 'theater') THEN 'soft-gates'
 WHEN n_strong >= 6 AND merge_governance <> 'missing' THEN 'hard-harness' ELSE 'real-gates' END"""
