"""Small text helpers for oracle statements."""

from __future__ import annotations

from repoaudit.functions.regex import Bank, group_count
from repoaudit.queries.derived import files_cte, lines_cte, sql_text
from repoaudit.rules.surface import SURFACES

SUFFIX = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
NAME = "regexp_extract(path, '[^/]*$')"


def rx(col: str, rules: Bank | str) -> str:
    pattern = rules.regex if isinstance(rules, Bank) else rules
    return f"regexp_matches({col}, {sql_text(pattern)})"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def extract_first(col: str, rules: Bank) -> str:
    arms = []
    for p in rules.each():
        group = 1 if group_count(p) else 0
        arms.append(f"WHEN {rx(col, p)} THEN {strip(f'regexp_extract({col}, {sql_text(p)}, {group})')}")
    return "CASE " + " ".join(arms) + " END"


def line_of(text: str, needle: str) -> str:
    before = f"substr({text}, 1, strpos({text}, {needle}) - 1)"
    return (
        f"CASE WHEN strpos({text}, {needle}) > 0 THEN length({before}) - length(replace({before}, chr(10), '')) + 1 END"
    )


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_array(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def surface_where(surface: str) -> str:
    rule = SURFACES[surface]
    keep = f"{SUFFIX} IN {sql_in(rule['suffixes'])}"
    if rule["names"]:
        keep = f"({keep} OR {NAME} IN {sql_in(rule['names'])})"
    if rule["skip"]:
        keep += f" AND NOT list_has_any(string_split(path, '/')[:-2], {sql_array(rule['skip'])})"
    if rule.get("prune_dot_dirs"):
        keep += r" AND NOT regexp_matches(path, '(?:^|/)\.[^/]*/')"
    if rule.get("first_party_only"):
        keep += r" AND NOT regexp_matches(path, '(?:^|/)\.council-runtime/(?:.*/)?site-packages/')"
    return keep


def with_files(*ctes: str, select: str, lines: bool = False) -> str:
    parts = [files_cte()]
    if lines:
        parts.append(lines_cte())
    parts.extend(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + select


def severity_sql(found: str = "f") -> str:
    """Zero-filled severity counts for every repository."""
    sums = ", ".join(
        f"CAST(count(*) FILTER (WHERE {found}.severity = '{s}') AS BIGINT) AS {s}"
        for s in ("critical", "high", "medium", "low")
    )
    return sums
