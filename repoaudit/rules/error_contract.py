"""Public error contract rules. Fixed values."""

from __future__ import annotations

from repoaudit.functions.regex import bank
from repoaudit.rules.surface import CODE

OPENAPI = r"(?i:\bopenapi\b|\bswagger\b)"
ASYNCAPI = r"(?i:\basyncapi\b)"
PROBLEM_MEDIA = r"(?i:application/problem\+json)"
PROBLEM_DETAILS = r"(?i:\bproblem details\b|problem\+json)"
CORE_FIELDS = {
    "type": r"""(?i:["']type["']\s*[:=]|\btype:\s*https?://)""",
    "title": r"""(?i:["']title["']\s*[:=])""",
    "status": r"""(?i:["']status["']\s*[:=]|\bstatus_code\b)""",
    "detail": r"""(?i:["']detail["']\s*[:=])""",
    "instance": r"""(?i:["']instance["']\s*[:=])""",
}
EXTENSION_FIELDS = {
    "code": r"""(?i:["']code["']\s*[:=]|\berror_code\b|\bproblem_code\b)""",
    "trace_id": r"(?i:\btrace[_-]?id\b)",
    "timestamp": r"(?i:\btimestamp\b|\bdate-time\b)",
    "service": r"""(?i:["']service["']\s*[:=]|\bservice[_-]?name\b)""",
    "retry_after_ms": r"(?i:\bretry[_-]?after(?:_ms)?\b|\bRetry-After\b)",
    "errors_array": r"""(?i:["']errors["']\s*:\s*\[)""",
}
TRACE_FIELDS = ["code", "trace_id", "timestamp", "service"]
PATHS = {
    "catalog": r"(?i:error[-_]?codes?|error[_-]?catalog|problem[-_]?types?)",
    "handler": r"(?i:error|exception|middleware|handler|filters?|responses?|api|routes?)",
    "generated": r"(?i:generated|openapi|asyncapi|sdk|client|types?)",
    "schema": r"(?i:schema|spec|contract|openapi|asyncapi)",
}
FRAMEWORKS = {
    "fastapi": r"(?i:\bfastapi\b|\bAPIRouter\b)",
    "flask": r"(?i:\bflask\b|\bBlueprint\b)",
    "django": r"(?i:\bdjango\b|\bJsonResponse\b)",
    "express": r"(?i:\bexpress\b|\bres\.status\b)",
    "nestjs": r"(?i:\b@nestjs\b|\bHttpException\b)",
}
GLOBAL_HANDLER = bank(
    r"\bapp\.exception_handler\b", r"\badd_exception_handler\b", r"\bExceptionMiddleware\b", r"\b@Catch\b",
    r"\bsetErrorHandler\b", r"\berrorHandler\b",
    ignore_case=True,
)
TEXT_BRANCH = bank(
    r"""if\s+["'][^"']+(?:not found|expired|forbidden|invalid|timeout)[^"']*["']\s+in\s+[A-Za-z0-9_.()\[\]]+""",
    r"""\.(?:includes|contains|startswith|endswith)\(\s*["'][^"']+(?:not found|expired|forbidden|invalid|timeout)[^"']*["']\s*\)""",
    r"\b(?:detail|message|title)\b[^;\n]{0,80}\b(?:includes|contains|startswith|endswith)\(",
    ignore_case=True,
)
LEAKAGE = bank(
    r"\btraceback\.format_exc\(\)", r"\bformat_exc\(\)", r"\bstr\(exc\)\b", r"\brepr\(exc\)\b", r"\bstack\s*trace\b",
    r"\bsql(state|error)?\b",
    ignore_case=True,
)
OUTWARD = bank(
    r"(JSONResponse|HttpException|HTTPException|res\.status|return\s+\{[^}]{0,200}(detail|message|error)|problem\+json)",
    ignore_case=True,
)
NUMERIC_CODE = bank(r"""["']code["']\s*[:=]\s*\d{3,}""", ignore_case=True)
ASYNC_STRUCTURED = bank(r"(contentType\s*:\s*application/problem\+json|payload[^;\n]{0,80}(code|type|detail)|success/error union)", ignore_case=True)
DOC_CLAIM = bank(r"(problem\+json|trace_id|error catalog|generated types?)", ignore_case=True)
CI_GUARD = bank(r"(error[_-]?catalog|generated.*error|problem.*schema|codegen)", ignore_case=True)
CODEGEN_HINT = bank(r"(generated by|openapi-generator|datamodel-codegen|quicktype|as const|Literal\[|enum\s+[A-Za-z_]+Error)", ignore_case=True)
CODE_SUFFIXES = CODE
DOC_SUFFIXES = [".md", ".mdx", ".rst"]
STRUCTURED_SUFFIXES = [".yaml", ".yml", ".json"]

# category -> severity, confidence, scope, title, evidence, decision, gate
REPO_FINDINGS = {
    "universal-problem-gap": ("high", "medium", "repo", "No coherent shared Problem Details-style public error shape is visible", "Public API or handler surfaces exist, but shared Problem Details evidence is weak or missing.", "extract-shared-problem-schema", "fix-before-release"),
    "field-pattern-gap": ("high", "medium", "repo", "Public error shape lacks stable structured business codes", "Problem-shape or outward error evidence exists, but stable top-level `code` evidence is missing.", "introduce-structured-code", "fix-before-release"),
    "traceability-gap": ("medium", "medium", "repo", "Public error responses do not show consistent traceability metadata", "Visible public error-contract evidence is missing some of `trace_id`, `timestamp`, or `service`.", "inject-traceability", "fix-next"),
    "http-mapping-gap": ("high", "medium", "http", "OpenAPI surface lacks clear `application/problem+json` evidence", "OpenAPI-like surfaces exist, but no `application/problem+json` evidence was found.", "align-http-contract", "fix-before-release"),
    "async-contract-gap": ("high", "medium", "async", "Async error payload discipline is not clearly modeled", "AsyncAPI or event surfaces were found, but structured async error-payload evidence is weak.", "model-async-errors", "fix-before-release"),
    "no-global-handler": ("high", "medium", "runtime", "No credible global error translation layer is visible", "Handler surfaces were found, but no clear global exception boundary was detected.", "add-boundary-handler", "fix-before-release"),
    "ssot-missing": ("high", "medium", "repo", "Public error codes do not appear to have one dedicated source of truth", "Structured code usage was detected, but no dedicated error catalog surface was found across multiple public surfaces.", "create-catalog", "fix-before-release"),
    "codegen-drift": ("high", "medium", "repo", "Multi-language error artifacts do not appear to be generated from one source", "Python and TypeScript surfaces were detected, but no generated error-artifact surface was found.", "restore-codegen", "fix-before-release"),
    "ci-gate-missing": ("medium", "low", "repo", "Catalog or generated artifact drift is not visibly gated in CI", "Catalog-like surfaces were found, but no visible CI/pre-commit guard for error-contract drift was detected.", "add-drift-check", "fix-next"),
    "docs-runtime-drift": ("medium", "low", "repo", "Documentation claims look stronger than visible runtime error-governance evidence", "Documentation mentions structured error-governance signals, but runtime evidence remains weak.", "close-doc-runtime-gap", "watch"),
}
SSOT_SOFT = (
    "medium",
    "Structured public error codes exist, but the source of truth is still implicit",
    "Structured code usage was detected, but no dedicated catalog surface was found. In a single-language repo with a coherent boundary this is debt, not immediate proof of drift.",
    "fix-next",
)
FILE_FINDINGS = {
    "text-branching": ("critical", "high", "Business control flow depends on message text", "replace-text-branching", "block-now"),
    "leakage-risk": ("critical", "high", "Outward-facing error path appears to leak internal detail", "strip-internals", "block-now"),
    "numeric-or-vague-code": ("high", "medium", "Business identity appears to rely on numeric error codes", "stabilize-codes", "fix-before-release"),
}

# conditions over the repository counters, in ANSI SQL
PUBLIC = "(n_openapi > 0 OR n_asyncapi > 0 OR n_handler > 0)"
CORE_COUNT = " + ".join(f"CASE WHEN core_{k} > 0 THEN 1 ELSE 0 END" for k in CORE_FIELDS)
TRACE_COUNT = " + ".join(f"CASE WHEN ext_{k} > 0 THEN 1 ELSE 0 END" for k in TRACE_FIELDS)
LANGUAGES = "CASE WHEN l_python THEN 1 ELSE 0 END + CASE WHEN l_typescript THEN 1 ELSE 0 END + CASE WHEN l_javascript THEN 1 ELSE 0 END"
CONDITIONS = {
    "universal-problem-gap": f"{PUBLIC} AND NOT problem_media AND ({CORE_COUNT}) < 3",
    "field-pattern-gap": f"{PUBLIC} AND ext_code = 0",
    "traceability-gap": f"{PUBLIC} AND ({TRACE_COUNT}) < 4",
    "http-mapping-gap": "n_openapi > 0 AND NOT problem_media",
    "async-contract-gap": "n_asyncapi > 0 AND NOT async_structured",
    "no-global-handler": "n_handler > 0 AND NOT global_handler",
    "ssot-missing": f"{PUBLIC} AND ext_code > 0 AND n_catalog = 0",
    "codegen-drift": "l_python AND l_typescript AND n_generated = 0",
    "ci-gate-missing": "n_catalog > 0 AND NOT ci_guard",
    "docs-runtime-drift": f"n_doc_claims > 0 AND {PUBLIC} AND NOT problem_media AND NOT global_handler",
}
SSOT_IS_HIGH = f"(({LANGUAGES}) >= 2 OR n_asyncapi > 0)"
# over counters plus boolean columns named after the categories present (dashes become underscores)
GATES = {
    "universal-problem-shape": f"CASE WHEN universal_problem_gap OR field_pattern_gap THEN 'fail' WHEN {PUBLIC} THEN 'pass' ELSE 'not-applicable' END",
    "stable-business-codes": "CASE WHEN text_branching OR numeric_or_vague_code THEN 'fail' WHEN ssot_missing THEN 'watch' WHEN ext_code > 0 OR n_catalog > 0 THEN 'pass' ELSE 'watch' END",
    "protocol-alignment": "CASE WHEN http_mapping_gap OR async_contract_gap THEN 'fail' WHEN n_openapi > 0 OR n_asyncapi > 0 THEN 'pass' ELSE 'not-applicable' END",
    "boundary-safety": f"CASE WHEN leakage_risk OR no_global_handler THEN 'fail' WHEN traceability_gap THEN 'watch' WHEN {PUBLIC} THEN 'pass' ELSE 'not-applicable' END",
    "ssot-and-codegen": f"CASE WHEN codegen_drift OR (ssot_missing AND ({LANGUAGES}) >= 2) THEN 'fail' WHEN ssot_missing OR ci_gate_missing THEN 'watch' ELSE 'pass' END",
}
ANY_FAIL = " OR ".join(f"({g}) = 'fail'" for g in GATES.values())
VERDICT = f"""CASE WHEN NOT {PUBLIC} AND n_catalog = 0 AND n_generated = 0 THEN 'not-applicable'
 WHEN critical > 0 OR high >= 3 THEN 'blocked' WHEN high > 0 OR {ANY_FAIL} THEN 'partial'
 WHEN total > 0 THEN 'watch' ELSE 'healthy' END"""
