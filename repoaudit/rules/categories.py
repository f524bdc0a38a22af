"""Category audits as data: which lines and files count, and how counts become states. Fixed values.

``states`` are ANSI CASE expressions over the per-repository counters:
``n_<rule>`` matching lines, ``ci_<rule>`` of them in workflow files, ``f_<rule>`` matching files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from repoaudit.functions.regex import Bank, bank

WORKFLOWS = ".github/workflows/"


@dataclass(frozen=True)
class Scope:
    """Files a rule looks at: every given test must hold."""

    suffixes: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    path: str | None = None
    name: str | None = None
    text: str | None = None


@dataclass(frozen=True)
class LineRule:
    """Lines hitting a bank, inside a scope, unless they also hit ``unless``."""

    id: str
    hits: Bank
    scope: Scope = Scope()
    unless: Bank | None = None
    stripped: bool = False


@dataclass(frozen=True)
class FileRule:
    """Files matching any of the scopes."""

    id: str
    any_of: tuple[Scope, ...]


@dataclass(frozen=True)
class Weak:
    """A finding raised when a category is in one of the listed states."""

    category: str
    title: str
    severity: dict[str, str]
    confidence: str
    at: str | None = None
    evidence: str = ""
    when: str | None = None


@dataclass(frozen=True)
class CategoryAudit:
    domain: str
    lines: tuple[LineRule, ...]
    files: tuple[FileRule, ...]
    applicable: str
    states: dict[str, str]
    weak: tuple[Weak, ...] = field(default=())
    verdict: str = "standard"


def ci(*patterns: str) -> Bank:
    return bank(*patterns, ignore_case=True)


CONFIG = (".yml", ".yaml", ".toml", ".json", ".sh")
CONFIG_AND_DOCS = (".yml", ".yaml", ".toml", ".json", ".md", ".sh")
JS_CONFIG = (".json", ".yaml", ".yml", ".sh", ".toml", ".js", ".ts")
YAML = (".yml", ".yaml")

PYTHON_LINT = CategoryAudit(
    "python-lint-format",
    lines=(
        LineRule("check", bank(r"ruff\s+check"), Scope(CONFIG_AND_DOCS)),
        LineRule("format", bank(r"ruff\s+format(?:\s+--check)?"), Scope(CONFIG_AND_DOCS)),
        LineRule("precommit", bank(r"ruff\s+check"), Scope(names=(".pre-commit-config.yaml",))),
        LineRule(
            "suppress", bank(r"#\s*noqa\b", r"per-file-ignores", r"extend-exclude", r"exclude\s*="),
            Scope((".py", ".pyi", ".toml", ".cfg", ".ini")),
        ),
        LineRule("legacy", bank(r"\bblack\b", r"\bisort\b", r"\bflake8\b"), Scope(CONFIG)),
        LineRule("gate", bank(r"ruff\s+check"), Scope(CONFIG)),
    ),
    files=(
        FileRule("python", (Scope((".py", ".pyi")),)),
        FileRule(
            "ruff",
            (
                Scope(names=("ruff.toml", ".ruff.toml")),
                Scope(names=("pyproject.toml",), text=r"(?m:\[tool\.ruff\]|^\s*extend\s*=|^\s*line-length\s*=)"),
            ),
        ),
        FileRule(
            "legacy_config",
            (
                Scope(
                    names=("pyproject.toml", ".flake8", "tox.ini", "setup.cfg"),
                    text=r"\[tool\.black\]|\[tool\.isort\]|\[flake8\]|max-line-length\s*=",
                ),
            ),
        ),
        FileRule(
            "generated", (Scope((".py", ".pyi"), path=r"(?i:generated|vendor|vendors|fixtures?/generated|migrations)"),)
        ),
        FileRule(
            "scoped",
            (
                Scope(
                    names=("pyproject.toml", "ruff.toml", ".ruff.toml", ".flake8", "setup.cfg", "tox.ini"),
                    text=r"generated|vendor|migrations",
                ),
            ),
        ),
    ),
    applicable="f_python > 0",
    states={
        "toolchain-normalization": "CASE WHEN f_ruff > 0 AND n_legacy = 0 AND f_legacy_config = 0 THEN 'hardened' WHEN f_ruff > 0 OR f_legacy_config > 0 OR n_legacy > 0 THEN 'partial' ELSE 'missing' END",
        "config-coherence": "CASE WHEN f_ruff = 1 AND f_legacy_config = 0 AND n_legacy = 0 THEN 'hardened' WHEN f_ruff > 1 OR (f_ruff > 0 AND n_legacy > 0) THEN 'partial' WHEN f_ruff > 0 THEN 'enforced' ELSE 'missing' END",
        "enforcement-gates": "CASE WHEN n_check > 0 AND n_format > 0 AND n_precommit > 0 THEN 'hardened' WHEN n_check > 0 AND n_format > 0 THEN 'enforced' WHEN n_check > 0 OR n_precommit > 0 THEN 'partial' ELSE 'missing' END",
        "suppression-governance": "CASE WHEN n_suppress = 0 THEN 'hardened' WHEN n_suppress <= 3 THEN 'enforced' ELSE 'partial' END",
        "scope-hygiene": "CASE WHEN f_generated = 0 OR f_scoped > 0 THEN 'enforced' ELSE 'partial' END",
    },
    weak=(
        Weak("toolchain-normalization", "Python lint stack is not cleanly normalized", {"missing": "high", "partial": "medium"}, "high", "legacy", "Python source exists without a clean modern lint stack."),
        Weak("enforcement-gates", "Ruff gates are not fully visible in normal workflow", {"missing": "high", "partial": "medium"}, "medium", "gate", "No complete Ruff gate chain was visible in CI or pre-commit."),
        Weak("suppression-governance", "Suppressions and excludes are broad enough to hide drift", {"partial": "medium"}, "medium", "suppress"),
        Weak("scope-hygiene", "Generated-like Python paths are not clearly isolated from the lint surface", {"partial": "medium"}, "medium", None, "Generated or migration-heavy paths were found without matching scope controls."),
    ),
)

TS_LINT = CategoryAudit(
    "ts-lint-format",
    lines=(
        LineRule("biome", bank(r"\bbiome\b"), Scope((".json", ".yaml", ".yml", ".sh", ".toml"))),
        LineRule("eslint", bank(r"\beslint\b"), Scope(JS_CONFIG)),
        LineRule("prettier", bank(r"\bprettier\b"), Scope(JS_CONFIG)),
        LineRule("suppress", bank(r"eslint-disable", r"@ts-ignore", r"@ts-expect-error"), Scope((".ts", ".tsx"))),
        LineRule("typed", ci(r"projectService", r"tsconfig"), Scope((".js", ".ts", ".json", ".yaml", ".yml"))),
    ),
    files=(
        FileRule("ts", (Scope((".ts", ".tsx")),)),
        FileRule("biome", (Scope(names=("biome.json", "biome.jsonc")),)),
        FileRule("eslint", (Scope(name=r"^(?:eslint\.config|\.eslintrc)"),)),
        FileRule(
            "typed_eslint",
            (Scope(name=r"^(?:eslint\.config|\.eslintrc)", text=r"(?i:projectService|parserOptions\s*:\s*\{[^}]*project|tsconfig)"),),
        ),
        FileRule("packages", (Scope(names=("package.json",), text=r'"(?:dependencies|devDependencies)"\s*:'),)),
    ),
    applicable="f_ts > 0",
    states={
        "toolchain-consolidation": "CASE WHEN f_biome > 0 AND n_prettier = 0 THEN CASE WHEN f_eslint > 0 THEN 'hardened' ELSE 'enforced' END WHEN n_eslint > 0 AND n_prettier > 0 AND f_biome = 0 THEN 'partial' WHEN f_biome > 0 OR f_eslint > 0 THEN 'partial' ELSE 'missing' END",
        "typed-lint-layer": "CASE WHEN f_eslint > 0 AND f_typed_eslint > 0 THEN CASE WHEN f_biome > 0 THEN 'hardened' ELSE 'enforced' END WHEN f_eslint > 0 THEN 'partial' ELSE 'missing' END",
        "workspace-coverage": "CASE WHEN f_packages > 1 AND n_biome = 0 AND n_eslint = 0 THEN 'partial' ELSE 'enforced' END",
        "suppression-governance": "CASE WHEN n_suppress = 0 THEN 'hardened' WHEN n_suppress <= 4 THEN 'enforced' ELSE 'partial' END",
        "ci-enforcement": "CASE WHEN n_biome + n_eslint > 0 THEN CASE WHEN ci_biome + ci_eslint > 0 THEN 'hardened' ELSE 'enforced' END ELSE 'missing' END",
    },
    weak=(
        Weak("toolchain-consolidation", "TypeScript style layer is not cleanly consolidated", {"missing": "high", "partial": "medium"}, "high", "prettier", "TypeScript style-layer truth is split or missing."),
        Weak("typed-lint-layer", "Typed lint is missing or weakly wired", {"missing": "high", "partial": "medium"}, "medium", "typed", "Typed lint is absent or not clearly wired to project types."),
        Weak("suppression-governance", "TypeScript suppressions are dense enough to weaken lint trust", {"partial": "medium"}, "medium", "suppress"),
    ),
)

SCHEMA_GOVERNANCE = CategoryAudit(
    "schema-governance",
    lines=(
        LineRule("lint", ci(r"redocly\s+(?:lint|bundle)", r"spectral\s+lint", r"check-jsonschema", r"ajv\s+validate")),
        LineRule("diff", ci(r"openapi[- ]diff", r"oasdiff", r"swagger[- ]diff", r"breaking[- ]change", r"azure/oad", r"oad\s+diff")),
        LineRule("publish", ci(r"publish", r"upload-artifact", r"pages", r"artifact", r"schema registry", r"swaggerhub"), Scope(YAML)),
        LineRule("any_publish", ci(r"publish", r"upload-artifact", r"pages", r"artifact", r"schema registry", r"swaggerhub")),
        LineRule("workflow", ci(r"redocly", r"spectral", r"check-jsonschema", r"ajv", r"openapi[- ]diff", r"oasdiff", r"upload-artifact", r"pages"), Scope(YAML)),
        LineRule("redocly", ci(r"redocly"), Scope(names=("package.json", "pyproject.toml", "justfile", "Makefile"))),
        LineRule("spectral", ci(r"spectral"), Scope(names=("package.json", "pyproject.toml", "justfile", "Makefile"))),
    ),
    files=(
        FileRule(
            "schema",
            (
                Scope((".json", ".yaml", ".yml"), path=r"(?i:openapi|swagger|schema|oas)"),
                Scope((".json", ".yaml", ".yml"), text=r'(?i:^\s*openapi:\s*3|"\$schema"|"definitions"|jsonschema)'),
            ),
        ),
        FileRule("rulesets", (Scope(names=("redocly.yaml", ".redocly.yaml", ".spectral.yaml", ".spectral.yml")),)),
        FileRule(
            "sources",
            (
                Scope((".json", ".yaml", ".yml"), path=r"(?i:(?:openapi|schemas?|specs?|api[-_/]?contracts?)[^/]*/(?:[^/]*/)*[^/]*(?:openapi|swagger|schema|oas)|(?:openapi|schemas?)[^/]*/)"),
                Scope((".json", ".yaml", ".yml"), path=r"(?i:(?:openapi|schemas?|specs?|api[-_/]?contracts?).*/)", text=r'(?i:^\s*openapi:\s*3|"\$schema"|"definitions"|jsonschema)'),
            ),
        ),
        FileRule(
            "generated",
            (
                Scope((".json", ".yaml", ".yml"), path=r"(?i:(?:generated|gen[-_/]|client[-_/]|sdk[-_/]|dist/).*(?:openapi|swagger|schema|oas)|(?:openapi|swagger|schema|oas).*(?:generated|gen[-_/]|client[-_/]|sdk[-_/]|dist/))"),
                Scope((".json", ".yaml", ".yml"), path=r"(?i:generated|gen[-_/]|client[-_/]|sdk[-_/]|dist/)", text=r'(?i:^\s*openapi:\s*3|"\$schema"|"definitions"|jsonschema)'),
            ),
        ),
    ),
    applicable="f_schema > 0 OR f_rulesets > 0 OR n_lint > 0",
    states={
        "artifact-health": "CASE WHEN f_schema > 0 AND n_lint > 0 THEN 'hardened' WHEN f_schema > 0 THEN 'partial' ELSE 'missing' END",
        "ruleset-governance": "CASE WHEN f_rulesets >= 2 THEN 'hardened' WHEN f_rulesets > 0 OR n_redocly > 0 OR n_spectral > 0 THEN 'enforced' ELSE 'missing' END",
        "source-of-truth-discipline": "CASE WHEN f_generated > 0 AND f_sources = 0 THEN 'missing' WHEN f_generated > 0 THEN 'partial' WHEN f_sources > 0 THEN 'enforced' ELSE 'partial' END",
        "breaking-change-detection": "CASE WHEN ci_diff > 0 THEN 'enforced' WHEN n_diff > 0 THEN 'partial' ELSE 'missing' END",
        "ci-publication-surface": "CASE WHEN n_workflow > 0 AND n_publish > 0 THEN 'hardened' WHEN n_workflow > 0 THEN 'partial' ELSE 'missing' END",
    },
    weak=(
        Weak("artifact-health", "Schema artifacts exist without a clear lint / bundle chain", {"partial": "medium"}, "medium", "lint", "No lint / bundle entry was detected."),
        Weak("ruleset-governance", "Schema governance lacks an explicit ruleset layer", {"missing": "high"}, "medium"),
        Weak("source-of-truth-discipline", "Canonical schema source is ambiguous", {"missing": "high", "partial": "medium"}, "by-state"),
        Weak("breaking-change-detection", "Schema changes are not protected by a CI-visible diff gate", {"missing": "high", "partial": "medium"}, "medium", "diff", "No breaking-change gate was detected."),
        Weak("ci-publication-surface", "Schema governance is weakly represented in CI and publication steps", {"missing": "medium", "partial": "medium"}, "medium", "any_publish", "No CI publication evidence was detected."),
    ),
)

FRONTEND = CategoryAudit(
    "frontend-regression",
    lines=(
        LineRule("browser", ci(r"playwright", r"browser\s*:\s*\{", r"browserMode", r"@vitest/browser")),
        LineRule("jsdom", ci(r"jsdom", r"happy-dom")),
        LineRule("mock", ci(r"msw", r"setupServer", r"setupWorker", r"rest\.(?:get|post|put|patch|delete)", r"http\.(?:get|post|put|patch|delete)")),
        LineRule("internal", ci(r"jest\.mock", r"vi\.mock", r"mockImplementation", r"mockResolvedValue")),
        LineRule("axe", ci(r"@axe-core/playwright", r"axe\(")),
        LineRule("visual", ci(r"toHaveScreenshot", r"snapshotPathTemplate", r"percy", r"chromatic", r"compareSnapshot")),
        LineRule("workflow", ci(r"playwright", r"vitest", r"upload-artifact", r"trace", r"screenshot", r"retries:"), Scope(YAML)),
        LineRule("any_workflow", ci(r"playwright", r"vitest", r"upload-artifact", r"trace", r"screenshot", r"retries:")),
    ),
    files=(
        FileRule("frontend", (Scope(name=r"(?i:\.(?:tsx?|jsx?|html|css|scss|vue|svelte)$)"),)),
        FileRule("package", (Scope(names=("package.json",), text=r"(?i:vite|next|storybook|react|vue|svelte)"),)),
    ),
    applicable="f_frontend > 0 OR f_package > 0",
    states={
        "browser-fidelity": "CASE WHEN n_browser > 0 AND n_jsdom = 0 THEN 'hardened' WHEN n_browser > 0 THEN 'enforced' WHEN n_jsdom > 0 THEN 'partial' ELSE 'missing' END",
        "request-boundary-mocking": "CASE WHEN n_mock > 0 THEN 'enforced' WHEN n_internal > 0 THEN 'partial' ELSE 'missing' END",
        "accessibility-automation": "CASE WHEN n_axe > 0 THEN 'enforced' ELSE 'missing' END",
        "visual-regression": "CASE WHEN n_visual > 0 THEN 'hardened' ELSE 'missing' END",
        "ci-artifacts-and-stability": "CASE WHEN n_workflow > 0 AND n_visual > 0 THEN 'hardened' WHEN n_workflow > 0 THEN 'enforced' ELSE 'missing' END",
    },
    weak=(
        Weak("browser-fidelity", "Browser regression surface is weaker than the UI surface requires", {"missing": "high", "partial": "high", "enforced": "medium"}, "medium", "jsdom", "No real-browser regression entry was detected."),
        Weak("request-boundary-mocking", "Regression tests lack a clear request-boundary mock layer", {"missing": "medium", "partial": "medium"}, "medium", "internal", "No request-boundary mock layer was detected."),
        Weak("accessibility-automation", "Accessibility automation is absent from the visible browser test chain", {"missing": "medium"}, "medium"),
        Weak("visual-regression", "Visual regression evidence is missing", {"missing": "medium"}, "medium"),
        Weak("ci-artifacts-and-stability", "CI does not clearly preserve browser-regression evidence", {"missing": "medium", "enforced": "medium"}, "medium", "any_workflow", "No browser-regression workflow evidence was detected."),
    ),
)

IGNORE_FILES = ("pyproject.toml", "package.json", ".bandit", ".npmrc", "audit-ci.json", "audit-ci.jsonc", "uv.toml")
SECURITY = CategoryAudit(
    "security-posture",
    lines=(
        LineRule("py_audit", ci(r"osv-scanner", r"uv export", r"dependency[- ]audit", r"python[- ]dependency[- ]audit")),
        LineRule("ts_audit", ci(r"pnpm\s+audit", r"audit-ci", r"osv-scanner")),
        LineRule("bandit", ci(r"\bbandit\b")),
        LineRule("lock", ci(r"uv\s+sync\s+--frozen", r"uv\s+lock", r"pnpm\s+install\s+--frozen-lockfile", r"pnpm\s+fetch\s+--frozen-lockfile")),
        LineRule("workflow", ci(r"bandit", r"audit-ci", r"pnpm\s+audit", r"osv-scanner", r"safety", r"pip-audit", r"sarif", r"upload-artifact"), Scope(YAML)),
        LineRule("ignore", ci(r"ignore", r"allowlist", r"baseline", r"skip", r"audit-level", r"severity-level"), Scope(names=IGNORE_FILES)),
        LineRule("any_ignore", ci(r"ignore", r"allowlist", r"baseline", r"skip", r"audit-level", r"severity-level")),
    ),
    files=(
        FileRule("python", (Scope(name=r"(?i:\.py$)"),)),
        FileRule("ts", (Scope(name=r"(?i:\.(?:ts|tsx|js|jsx)$)"),)),
        FileRule("uv_lock", (Scope(path=r"^uv\.lock$"),)),
        FileRule("pnpm_lock", (Scope(path=r"^pnpm-lock\.yaml$"),)),
        FileRule(
            "private",
            (
                Scope(
                    names=("pyproject.toml", "uv.toml", ".npmrc", "package.json"),
                    text=r"(?i:index-url|extra-index-url|registry=|npm\.pkg\.github\.com|artifactory|verdaccio|private\s+registry)",
                ),
            ),
        ),
    ),
    applicable="f_python > 0 OR f_ts > 0 OR f_uv_lock > 0 OR f_pnpm_lock > 0",
    states={
        "python-known-vulns": "CASE WHEN f_python = 0 THEN 'not-applicable' WHEN f_uv_lock = 0 OR (f_private > 0 AND n_py_audit = 0) THEN 'blocked' WHEN ci_py_audit > 0 THEN 'enforced' WHEN n_py_audit > 0 THEN 'partial' ELSE 'missing' END",
        "ts-known-vulns": "CASE WHEN f_ts = 0 THEN 'not-applicable' WHEN f_pnpm_lock = 0 OR (f_private > 0 AND n_ts_audit = 0) THEN 'blocked' WHEN ci_ts_audit > 0 THEN 'enforced' WHEN n_ts_audit > 0 THEN 'partial' ELSE 'missing' END",
        "python-static-security": "CASE WHEN f_python = 0 THEN 'not-applicable' WHEN ci_bandit > 0 THEN 'enforced' WHEN n_bandit > 0 THEN 'partial' ELSE 'missing' END",
        "lockfile-install-discipline": "CASE WHEN (f_python > 0 AND f_uv_lock = 0) OR (f_ts > 0 AND f_pnpm_lock = 0) THEN 'blocked' WHEN n_lock > 0 THEN 'enforced' ELSE 'partial' END",
        "gate-and-ignore-governance": "CASE WHEN n_workflow > 0 AND n_ignore > 0 THEN 'enforced' WHEN n_workflow > 0 OR n_ignore > 0 THEN 'partial' ELSE 'missing' END",
    },
    weak=(
        Weak("python-known-vulns", "Python dependency vulnerability auditing is not trustworthy yet", {"blocked": "high", "missing": "medium", "partial": "medium"}, "medium", "py_audit", "No Python dependency-audit signal was detected."),
        Weak("ts-known-vulns", "TS / Node dependency vulnerability auditing is not trustworthy yet", {"blocked": "high", "missing": "medium", "partial": "medium"}, "medium", "ts_audit", "No TS dependency-audit signal was detected."),
        Weak("python-static-security", "Python static security scanning is weak or missing", {"missing": "medium", "partial": "medium"}, "medium", "bandit", "No Python static-security signal was detected."),
        Weak("lockfile-install-discipline", "Lockfile or frozen-install discipline is not strong enough", {"blocked": "high", "partial": "medium"}, "by-state", "lock", "No frozen-install discipline was detected."),
        Weak("gate-and-ignore-governance", "Ignore and governance evidence is incomplete", {"missing": "medium", "partial": "medium"}, "medium", "any_ignore", "No ignore-governance evidence was detected."),
    ),
)

SOURCE = (".py", ".ts", ".tsx", ".js", ".jsx")
TEST_FILE = r"(?i:(?:^|/)(?:tests|__tests__|spec|specs)/|(?:^|/)test_[^/]*$|_test\.py$|\.(?:test|spec)\.[^/]*$)"
TEST_SCOPE = Scope(SOURCE, path=TEST_FILE)
CI_SCOPE = Scope(YAML, path=r"^(?:\.github/workflows/|\.circleci/config\.yml$|\.gitlab-ci\.yml$|azure-pipelines\.yml$)")
TEST_QUALITY = CategoryAudit(
    "test-quality",
    lines=(
        LineRule("gate", ci(r"\b(?:pytest|unittest|vitest|jest|playwright|pnpm\s+test|npm\s+test|uv\s+run\s+pytest|python\s+-m\s+pytest)\b"), CI_SCOPE),
        LineRule(
            "placeholder",
            Bank(
                (
                    r"^\s*assert\s+True\s*$", r"^\s*assert\s+1\s*==\s*1\s*$", r"^\s*self\.assertTrue\(\s*True\s*\)\s*$",
                    r"(?i:^\s*expect\(\s*true\s*\)\.toBe\(\s*true\s*\)\s*;?\s*$)",
                    r"(?i:^\s*expect\(\s*1\s*\)\.toBe\(\s*1\s*\)\s*;?\s*$)", r"(?i:\b(?:it|test)\.todo\s*\()",
                )
            ),
            TEST_SCOPE,
            stripped=True,
        ),
        LineRule(
            "skip",
            Bank(
                (
                    r"pytest\.mark\.(?:skip|skipif|xfail)", r"@unittest\.skip", r"(?i:\b(?:it|test|describe)\.skip\s*\()",
                    r"(?i:\bretries\s*:\s*\d+)", r"\b(?:pytest\.mark\.flaky|@flaky|reruns\s*=)",
                )
            ),
            TEST_SCOPE,
            stripped=True,
        ),
        LineRule(
            "mock",
            Bank(
                (
                    r"\bmocker\.patch\s*\(", r"\bmonkeypatch\.setattr\s*\(", r"\bpatch(?:\.object)?\s*\(",
                    r"(?i:\b(?:jest|vi)\.mock\s*\()", r"(?i:\b(?:jest|vi)\.spyOn\s*\()",
                )
            ),
            TEST_SCOPE,
            unless=ci(r"\b(?:requests|httpx|axios|fetch|msw|respx|nock|redis|s3|smtp|stripe|twilio)\b"),
            stripped=True,
        ),
        LineRule(
            "failure",
            Bank(
                (
                    r"\bpytest\.raises\s*\(", r"\bassertRaises\s*\(", r"(?i:\bexpect\([^)]*\)\.(?:toThrow|rejects)\b)",
                    r"(?i:\btoThrow\s*\()", r"(?i:\braises?\s*=)",
                )
            ),
            TEST_SCOPE,
            stripped=True,
        ),
    ),
    files=(
        FileRule("source", (Scope(SOURCE),)),
        FileRule("tests", (TEST_SCOPE,)),
        FileRule("ci", (CI_SCOPE,)),
    ),
    applicable="f_source > 0 OR f_ci > 0",
    states={
        "ci-test-gate": "CASE WHEN n_gate > 0 THEN 'clean' ELSE 'watch' END",
        "placeholder-test-quality": "CASE WHEN f_tests = 0 THEN 'not-applicable' WHEN n_placeholder > 0 THEN 'watch' ELSE 'clean' END",
        "skip-retry-governance": "CASE WHEN f_tests = 0 THEN 'not-applicable' WHEN n_skip > 0 THEN 'watch' ELSE 'clean' END",
        "mock-discipline": "CASE WHEN f_tests = 0 THEN 'not-applicable' WHEN n_mock >= 3 THEN 'watch' ELSE 'clean' END",
        "failure-path-evidence": "CASE WHEN f_tests = 0 THEN 'not-applicable' WHEN n_failure > 0 THEN 'clean' ELSE 'watch' END",
    },
    weak=(
        Weak("ci-test-gate", "No trustworthy CI test gate is visible", {"watch": "high"}, "high", "gate", "No supported CI config file exposing a test gate was found."),
        Weak("placeholder-test-quality", "Placeholder or tautological test assertion found", {"watch": "high"}, "high", "placeholder"),
        Weak("skip-retry-governance", "Skip, xfail, or retry usage is visible in the suite", {"watch": "medium"}, "high", "skip"),
        Weak("mock-discipline", "Tests lean heavily on internal-logic mocking", {"watch": "medium"}, "medium", "mock"),
        Weak("failure-path-evidence", "Failure-path evidence is missing from the visible suite", {"watch": "medium"}, "medium", "failure", "The visible test files do not show common failure-path assertions."),
    ),
    verdict="watch",
)

# The written policy names what counts (key material, literals, placeholders) but fixes no expressions;
# the expressions below are this library's reading of it.
SECRET_MATERIAL = Bank(
    (
        r"\bAKIA[0-9A-Z]{16}\b",
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
        r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
        r"\bsk_live_[A-Za-z0-9]{16,}",
        r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
        r"(?i:\btoken\s*=\s*[\"'][0-9a-f]{40}[\"'])",
    )
)
CREDENTIAL_LITERAL = ci(
    r"(?:password|passwd|secret|api[_-]?key|client[_-]?secret|access[_-]?token)[\"']?\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']"
)
PLACEHOLDER = ci(
    r"[:=]\s*[\"'][^\"']*(?:change-?me|example|dummy|placeholder|your[-_]|xxxx)", r"[\"']\$\{[^}]*\}[\"']",
    r"[\"']<[^>]*>[\"']",
)
SECRET_FILE_GLOBS = [".env", "*.pem", "*.key"]
SECRETS = CategoryAudit(
    "secrets-and-hardcode",
    lines=(
        LineRule("material", SECRET_MATERIAL, unless=PLACEHOLDER),
        LineRule("literal", CREDENTIAL_LITERAL, unless=PLACEHOLDER),
        *[
            LineRule(f"ignore_{i}", bank("^" + g.replace(".", r"\.").replace("*", r"\*") + r"\s*$"), Scope(names=(".gitignore",)))
            for i, g in enumerate(SECRET_FILE_GLOBS)
        ],
    ),
    files=(FileRule("text", (Scope(),)),),
    applicable="f_text > 0",
    states={
        "working-tree-exposure": "CASE WHEN n_material > 0 THEN 'watch' ELSE 'clean' END",
        "history-exposure": "CASE WHEN n_history IS NULL THEN 'watch' WHEN n_history > 0 THEN 'watch' ELSE 'clean' END",
        "hardcoded-credentials": "CASE WHEN n_literal > 0 THEN 'watch' ELSE 'clean' END",
        "ignore-discipline": "CASE WHEN n_ignore_0 > 0 AND n_ignore_1 > 0 AND n_ignore_2 > 0 THEN 'clean' ELSE 'watch' END",
    },
    weak=(
        Weak("working-tree-exposure", "High-signal secret material is visible in the working tree", {"watch": "high"}, "high", "material"),
        Weak("hardcoded-credentials", "Credential literal is hardcoded", {"watch": "medium"}, "medium", "literal"),
        Weak("ignore-discipline", "Ignore rules do not cover common secret-bearing files", {"watch": "low"}, "medium"),
    ),
    verdict="watch",
)

AUDITS = {
    a.domain: a for a in (PYTHON_LINT, TS_LINT, SCHEMA_GOVERNANCE, FRONTEND, SECURITY, TEST_QUALITY, SECRETS)
}
