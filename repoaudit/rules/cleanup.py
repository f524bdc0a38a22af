"""Deprecation and cleanup rules. Fixed values."""

from __future__ import annotations

from repoaudit.functions.regex import Bank, bank

# order matters: the first pattern that occurs names the cue
DEPRECATION = Bank(
    (
        r"(?i:@deprecated\b)",
        r"@Deprecated\b",
        r"DeprecationWarning\b",
        r"(?im:^\s*(?:#|//|/\*+|\*|>|-)?\s*deprecated\b[:.])",
        r"(?i:REMOVE[-_ ]?AFTER\b)",
        r"(?i:\bsunset\s*[:=])",
    )
)
SHIM_PATH = r"(?i:(?:^|/)(?:legacy|compat|compatibility|shim|deprecated|adapters?/legacy)(?:/|$))"
SHIM_TEXT = bank(
    r"\bcompat(?:ibility)?\s+(?:shim|layer|adapter|wrapper)\b",
    r"\blegacy\s+alias\b",
    r"\bbackward compatible\b",
    ignore_case=True,
)
FEATURE_FLAG = Bank(
    (r"(?i:feature[_ -]?flag)", r"LaunchDarkly", r"OpenFeature", r"Unleash", r"flag[_A-Z]", r"is_enabled\(")
)
DYNAMIC_ENTRY = bank(
    r"\bgetattr\(",
    r"\bsetattr\(",
    r"\bimportlib\b",
    r"\b__import__\(",
    r"\beval\(",
    r"\bexec\(",
    r"\bClass\.forName\(",
    r"\bServiceLoader\b",
    r"\bReflect\.",
    r"\bimport\s*\(",
)
REPLACEMENT = bank(
    r"replace[-_ ]?with\s*[:=]\s*([^\n*]+)",
    r"use\s+([^\n]+?)\s+instead",
    r"replacement\s*[:=]\s*([^\n*]+)",
    ignore_case=True,
)
REMOVAL_TARGET = bank(
    r"remove[-_ ]?after\s*[:=]\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
    r"sunset\s*[:=]\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
    r"remove[-_ ]?(?:by|in|on|target)?\s*[:=]\s*(v?\d+\.\d+(?:\.\d+)?)",
    ignore_case=True,
)
TEST_DIRS = ["tests", "test", "spec", "specs", "__tests__"]
TEST_FILES = ["pytest.ini", "tox.ini", "noxfile.py", "jest.config.js", "vitest.config.ts"]
WORKFLOW_DIR = ".github/workflows/"
CI_FILES = [".gitlab-ci.yml", "Jenkinsfile", "azure-pipelines.yml"]

TITLES = {
    "deprecated-surface": "Repository contains an explicitly marked deprecated surface that likely needs migration or deletion planning.",
    "compatibility-shim": "File looks like a compatibility wrapper, alias, or shim rather than a real source of truth.",
    "cleanup-opportunity": "Path suggests a legacy or compatibility surface; confirm replacement and live references before deleting.",
    "expired-removal-target": "Deprecation marker indicates a removal target that is already in the past.",
    "marker-gap": "Explicit deprecation marker exists but is missing: ",
    "feature-flag-debt": "File contains feature-flag or fallback-path cues that may outlive the migration window.",
    "dynamic-entrypoint-risk": "Hidden references may exist because the file uses runtime indirection, reflection, or dynamic dispatch cues.",
    "no-tests": "Repository does not show obvious test layout or test runner hints, which weakens deletion confidence.",
    "no-ci": "Repository does not show obvious CI configuration, so cleanup validation may rely on local discipline only.",
    "no-manifests": "Repository exposes very few recognizable manifests; follow-up validation commands may need manual discovery.",
}
