"""Queries over the category-state audits: counters, states, findings, verdicts."""

from __future__ import annotations


from repoaudit.plans import categories as C
from repoaudit.queries import sqlgen as S
from repoaudit.queries.base import shown
from repoaudit.queries.derived import corpus
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import rx, surface_where, with_files
from repoaudit.rules.categories import AUDITS, CategoryAudit, LineRule, Scope


def scope_sql(scope: Scope) -> str:
    tests = []
    if scope.suffixes:
        tests.append(f"{S.SUFFIX} IN {S.sql_in(list(scope.suffixes))}")
    if scope.names:
        tests.append(f"{S.NAME} IN {S.sql_in(list(scope.names))}")
    if scope.path:
        tests.append(rx("path", scope.path))
    if scope.name:
        tests.append(rx(S.NAME, scope.name))
    if scope.text:
        tests.append(rx("text", scope.text))
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def line_sql(rule: LineRule) -> str:
    line = S.strip("line") if rule.stripped else "line"
    out = f"{scope_sql(rule.scope)} AND {rx(line, rule.hits)}"
    return f"{out} AND NOT {rx(line, rule.unless)}" if rule.unless else out


def counter_ctes(audit: CategoryAudit) -> list[str]:
    """Line hits from exploded lines, file flags from files, joined per repository."""
    hits = ", ".join(f"({line_sql(r)}) AS b_{r.id}" for r in audit.lines)
    sums = ", ".join(
        f"count(*) FILTER (WHERE b_{r.id}) AS n_{r.id}, count(*) FILTER (WHERE b_{r.id} AND path LIKE '%.github/workflows/%') AS ci_{r.id},"
        f" min({{'p': path, 'l': line_no, 't': {snip('line')}}}) FILTER (WHERE b_{r.id}) AS at_{r.id}"
        for r in audit.lines
    )
    files = ", ".join(
        "count(*) FILTER (WHERE " + " OR ".join(scope_sql(s) for s in r.any_of) + f") AS f_{r.id}" for r in audit.files
    )
    zero = ", ".join(
        [f"coalesce(n_{r.id}, 0) AS n_{r.id}, coalesce(ci_{r.id}, 0) AS ci_{r.id}, at_{r.id}" for r in audit.lines]
        + [f"coalesce(f_{r.id}, 0) AS f_{r.id}" for r in audit.files]
    )
    history = ", CAST(NULL AS BIGINT) AS n_history" if audit.domain == C.SECRET_DOMAIN else ""
    return [
        f"src AS (SELECT * FROM files WHERE {surface_where('text')})",
        "ln AS (SELECT repo_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM src))",
        f"lh AS (SELECT *, {hits} FROM ln)",
        f"ls AS (SELECT repo_id, {sums} FROM lh GROUP BY 1)",
        f"fs AS (SELECT repo_id, count(*) AS files_scanned, {files} FROM src GROUP BY 1)",
        f"rows AS (SELECT r.repo_id, coalesce(files_scanned, 0) AS files_scanned, {zero}{history} FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN ls USING (repo_id) LEFT JOIN fs USING (repo_id))",
    ]


def snip(col: str) -> str:
    return S.strip(col)


def states_cte(audit: CategoryAudit) -> str:
    arms = " UNION ALL ".join(
        f"SELECT repo_id, '{audit.domain}' AS domain, {i} AS ord, '{c}' AS category, CASE WHEN {audit.applicable} THEN {e} ELSE 'not-applicable' END AS state FROM rows"
        for i, (c, e) in enumerate(audit.states.items())
    )
    return f"states AS ({arms})"


def verdict_select(audit: CategoryAudit) -> str:
    if audit.verdict == "watch":
        tail = "WHEN bool_or(state = 'watch') THEN 'watch' ELSE 'clean' END"
    else:
        tail = "WHEN bool_or(state IN ('missing', 'partial')) THEN 'partial' WHEN bool_or(state = 'enforced') THEN 'enforced' ELSE 'hardened' END"
    return (
        "SELECT repo_id, domain, CASE WHEN bool_and(state = 'not-applicable') THEN 'not-applicable' "
        f"WHEN bool_or(state = 'blocked') THEN 'scan-blocked' {tail} AS verdict FROM states GROUP BY 1, 2"
    )


def weak_select(audit: CategoryAudit) -> str:
    arms = []
    for w in audit.weak:
        state = audit.states[w.category]
        severity = f"CASE {state} " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in w.severity.items()) + " END"
        conf = severity if w.confidence == "by-state" else f"'{w.confidence}'"
        at = f"at_{w.at}" if w.at else None
        text = f"{at}.t" if at else None
        if at and audit.domain == C.SECRET_DOMAIN:
            text = f"substr({text}, 1, 4) || '…'"
        path = f"coalesce({at}.p, '.')" if at else "'.'"
        line = f"coalesce({at}.l, 1)" if at else "1"
        evidence = f"coalesce({text}, {S.sql_text(w.evidence)})" if at else S.sql_text(w.evidence)
        arms.append(
            f"SELECT repo_id, {path} AS path, '{w.category}' AS category, {severity} AS severity, {conf} AS confidence, "
            f"{S.sql_text(w.title)} AS title, CAST({line} AS INTEGER) AS line, {evidence} AS evidence FROM rows "
            f"WHERE ({audit.applicable}) AND {severity} IS NOT NULL"
        )
    return " UNION ALL ".join(arms)


def counter_columns(audit: CategoryAudit) -> list[str]:
    return (
        ["repo_id", "files_scanned"]
        + [f"n_{r.id}" for r in audit.lines]
        + [f"ci_{r.id}" for r in audit.lines]
        + [f"f_{r.id}" for r in audit.files]
    )


def register(domain: str, audit: CategoryAudit) -> None:
    base = domain.replace("-", "_")
    ctes = counter_ctes(audit)

    @query(f"{base}_counters", with_files(*ctes, select=f"SELECT {', '.join(counter_columns(audit))} FROM rows"))
    def counters(spark, sf):
        return C.counters(corpus(spark, sf), domain).select(*counter_columns(audit))

    @query(f"{base}_states", with_files(*ctes, states_cte(audit), select="SELECT * FROM states"))
    def states(spark, sf):
        return C.audit(corpus(spark, sf), domain)[0]

    @query(f"{base}_findings", with_files(*ctes, select=weak_select(audit)))
    def findings(spark, sf):
        return shown(C.audit(corpus(spark, sf), domain)[1])

    @query(f"{base}_verdict", with_files(*ctes, states_cte(audit), select=verdict_select(audit)))
    def verdict(spark, sf):
        return C.audit(corpus(spark, sf), domain)[2]


for _domain, _audit in AUDITS.items():
    register(_domain, _audit)

REPORT_RULES = [AUDITS["test-quality"].lines[3], AUDITS["security-posture"].lines[2], AUDITS["frontend-regression"].lines[0]]
_match_sql = " UNION ALL ".join(
    f"SELECT repo_id, path, '{r.id}' AS rule, CAST(line_no AS INTEGER) AS line_no, {snip('line')} AS text FROM ln WHERE {line_sql(r)}"
    for r in REPORT_RULES
)
_src = counter_ctes(AUDITS["test-quality"])[:2]


@query("collect_matches", with_files(*_src, select=_match_sql))
def collect_matches(spark, sf):
    return C.collect_matches(corpus(spark, sf), REPORT_RULES)


@query(
    "collect_matches_report",
    with_files(*_src, f"m AS ({_match_sql})", select="SELECT repo_id, path, rule, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rule ORDER BY path, line_no) AS rn FROM m) WHERE rn <= 3"),
)
def collect_matches_report(spark, sf):
    return C.collect_matches(corpus(spark, sf), REPORT_RULES, limit=3)


@query(
    "first_match_location",
    with_files(*_src, f"m AS ({_match_sql})", select="SELECT repo_id, path, rule, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rule ORDER BY path, line_no) AS rn FROM m) WHERE rn = 1"),
)
def first_match_location(spark, sf):
    return C.first_match_location(corpus(spark, sf), REPORT_RULES)


