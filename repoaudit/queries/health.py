"""Queries over the roll-up: classification, health, clusters, actions, unknowns, run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.plans import rollup as R
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.derived import sql_text
from repoaudit.queries.registry import query
from repoaudit.rules import catalog as C
from repoaudit.session import stage

CATALOG = "cat(ord, domain, cluster) AS (VALUES " + ", ".join(f"({i}, '{d}', '{c}')" for i, (d, c) in enumerate(C.DOMAINS.items())) + ")"
_KEYS = S.sql_array(C.REQUIRED_SUMMARY_KEYS)
_MISSING = f"list_sort(list_filter({_KEYS}, lambda x: NOT list_contains(ks, x)))"
_X = lambda k: f"coalesce(json_extract_string(j, '$.{k}'), '')"
_T = lambda k: f"coalesce(json_type(j, '$.{k}'), '')"
_DASH = lambda k: f"CASE WHEN {_X(k)} = '' THEN '-' ELSE {_X(k)} END"
_SEV_OK = " AND ".join(f"TRY_CAST(json_extract_string(j, '$.severity_counts.{s}') AS INTEGER) IS NOT NULL" for s in ("critical", "high", "medium", "low"))
_LISTS = "json_type(j, '$.dependency_failures') = 'ARRAY' AND json_array_length(j, '$.dependency_failures') > 0"
STEPS = [
    ("json IS NULL", "'missing'", "'summary file not found'"),
    ("j IS NULL OR json_type(j) <> 'OBJECT'", "'invalid'", "'invalid: not a JSON object'"),
    ("len(ks) = 0", "'missing'", "'summary file not found'"),
    (f"{_X('skill')} <> '' AND {_X('skill')} <> skill", "'invalid'", f"'summary skill mismatch: expected ' || skill || ', got ' || {_X('skill')}"),
    (f"{_X('run_id')} <> '{D.RUN_ID}'", "'invalid'", f"'run_id mismatch: expected {D.RUN_ID}, got ' || {_DASH('run_id')}"),
    (f"len({_MISSING}) > 0", "'invalid'", f"'summary missing required keys: [''' || array_to_string({_MISSING}, ''', ''') || ''']'"),
    (f"{_T('overall_verdict')} <> 'VARCHAR' OR {_X('overall_verdict')} = ''", "'invalid'", "'overall_verdict must be a non-empty string'"),
    (f"{_X('rollup_bucket')} NOT IN ('blocked', 'red', 'yellow', 'green', 'not-applicable')", "'invalid'", f"'invalid rollup_bucket: ' || {_DASH('rollup_bucket')}"),
    (f"{_X('dependency_status')} NOT IN ('ready', 'auto-installed', 'blocked')", "'invalid'", f"'invalid dependency_status: ' || {_DASH('dependency_status')}"),
    (f"{_T('bootstrap_actions')} <> 'ARRAY'", "'invalid'", "'bootstrap_actions must be a list'"),
    (f"{_T('dependency_failures')} <> 'ARRAY'", "'invalid'", "'dependency_failures must be a list'"),
    (f"{_X('dependency_status')} = 'blocked' AND NOT ({_LISTS})", "'invalid'", "'dependency_status=blocked requires at least one dependency_failure'"),
    (f"NOT ({_SEV_OK})", "'invalid'", "'severity_counts must contain integer critical/high/medium/low keys'"),
    (f"{_T('findings')} <> 'ARRAY' OR len(list_filter(CAST(json_extract(j, '$.findings') AS JSON[]), lambda x: json_type(x) <> 'OBJECT')) > 0", "'invalid'", "'findings must be a list of objects'"),
    (f"{_X('rollup_bucket')} = 'not-applicable'", "'not-applicable'", "'child skill marked this domain not applicable'"),
    (f"{_X('dependency_status')} = 'blocked' OR {_X('rollup_bucket')} = 'blocked'", "'blocked'", "''"),
]
_CASE = lambda i: "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i]}" for s in STEPS)
RUN_CTES = [
    D.summaries_cte(),
    CATALOG,
    "art AS (SELECT repo_id, domain, k % 29 <> 0 AS has_report, k % 31 <> 0 AS has_brief FROM sk)",
    "base AS (SELECT r.repo_id, cat.*, cat.domain || '-audit' AS skill, s.json, CASE WHEN json_valid(s.json) THEN CAST(s.json AS JSON) END AS j, CASE WHEN json_valid(s.json) THEN json_keys(CAST(s.json AS JSON)) ELSE [] END AS ks, "
    "coalesce(has_report, false) AS has_report, coalesce(has_brief, false) AS has_brief FROM (SELECT DISTINCT repo_id FROM sk) r CROSS JOIN cat LEFT JOIN summaries s ON s.repo_id = r.repo_id AND s.domain = cat.domain LEFT JOIN art ON art.repo_id = r.repo_id AND art.domain = cat.domain)",
    f"cl AS (SELECT *, {_CASE(1)} ELSE 'present' END AS st0, {_CASE(2)} ELSE '' END AS nt0 FROM base)",
    "ga AS (SELECT *, concat_ws('; ', CASE WHEN NOT has_report THEN 'human report missing at ' || domain || '/report.md' END, CASE WHEN NOT has_brief THEN 'agent brief missing at ' || domain || '/agent-brief.md' END) AS gap FROM cl)",
    "gb AS (SELECT *, st0 NOT IN ('missing', 'invalid') AND gap <> '' AS gated FROM ga)",
    f"""ru0 AS (SELECT repo_id, ord, domain, cluster, skill, CASE WHEN gated THEN 'invalid' ELSE st0 END AS status, CASE WHEN {_X('dependency_status')} = '' THEN 'ready' ELSE {_X('dependency_status')} END AS dependency_status,
 CASE WHEN gated THEN gap ELSE nt0 END AS nt, CASE WHEN {_T('dependency_failures')} = 'ARRAY' THEN json_extract_string(j, '$.dependency_failures[0].name') END AS failure_name, CASE WHEN {_T('dependency_failures')} = 'ARRAY' THEN json_extract_string(j, '$.dependency_failures[0].failure_reason') END AS reason,
 {_X('overall_verdict')} AS ov, {_X('rollup_bucket')} AS rb, j, has_report, has_brief, {_SEV_OK} AS sev_ok FROM gb)""",
    """ru1 AS (SELECT *, CASE WHEN status IN ('missing', 'invalid') THEN '' ELSE ov END AS child_verdict, CASE WHEN status IN ('missing', 'invalid') THEN '' ELSE rb END AS rollup_bucket FROM ru0)""",
    """runs AS (SELECT *, CASE WHEN status = 'invalid' THEN CASE WHEN nt = '' THEN 'child artifact contract failed validation' ELSE nt END
 WHEN dependency_status = 'blocked' THEN coalesce(failure_name, 'dependency') || ': ' || coalesce(reason, 'dependency bootstrap blocked the child skill')
 WHEN rollup_bucket = 'blocked' THEN CASE WHEN child_verdict = '' THEN 'child summary declared a blocked rollup bucket' ELSE child_verdict END
 WHEN domain = 'llm-api-freshness' AND child_verdict = 'triage' THEN 'this run only produced local surface triage; current docs were not verified'
 WHEN domain = 'llm-api-freshness' AND child_verdict = 'verified' THEN 'current provider docs were verified for the detected surfaces' ELSE nt END AS notes FROM ru1)""",
    "fi AS (SELECT repo_id, domain, ord, cluster, i, coalesce(f->>'category', f->>'gate', f->>'domain', f->>'kind') AS c FROM (SELECT repo_id, domain, ord, cluster, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM (SELECT *, CAST(json_extract(j, '$.findings') AS JSON[]) AS fs FROM runs WHERE json_type(j, '$.findings') = 'ARRAY')) WHERE json_type(f) = 'OBJECT')",
    "tc AS (SELECT repo_id, domain, ord, cluster, c, rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, domain ORDER BY n DESC, i) AS rn FROM (SELECT repo_id, domain, ord, cluster, c, count(*) AS n, min(i) AS i FROM fi WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4, 5)) WHERE rn <= 3)",
    "tl AS (SELECT repo_id, domain, array_to_string(list(c ORDER BY rn), ',') AS top_categories FROM tc GROUP BY 1, 2)",
]
WITH = "WITH " + ",\n".join(RUN_CTES)


def runs_of(spark, sf):
    keys = D.summary_keys(spark, sf)
    return R.classify_runs(D.summaries(spark, sf), D.RUN_ID, keys, D.artifacts(spark, sf))


_SEVCOLS = ", ".join(f"CASE WHEN coalesce(sev_ok, false) THEN CAST(json_extract_string(j, '$.severity_counts.{s}') AS INTEGER) ELSE 0 END AS {s}" for s in ("critical", "high", "medium", "low"))


@query(
    "rollup_runs",
    WITH + f" SELECT r.repo_id, r.domain, status, dependency_status, child_verdict, rollup_bucket, notes, {_SEVCOLS}, coalesce(top_categories, '') AS top_categories FROM runs r LEFT JOIN tl ON tl.repo_id = r.repo_id AND tl.domain = r.domain",
)
def rollup_runs(spark, sf):
    return runs_of(spark, sf).select(
        "repo_id", "domain", "status", "dependency_status", "child_verdict", "rollup_bucket", "notes", "critical", "high", "medium", "low",
        F.array_join("top_categories", ",").alias("top_categories"),
    )


HEALTH = """ha AS (SELECT repo_id, count(*) FILTER (WHERE status NOT IN ('missing', 'invalid')) AS p, count(*) FILTER (WHERE status IN ('missing', 'invalid')) AS g, count(*) FILTER (WHERE status = 'not-applicable') AS na,
 bool_or(status = 'blocked' OR rollup_bucket = 'red') AS b, bool_or(rollup_bucket = 'yellow') AS y, coalesce(array_to_string(list(skill ORDER BY ord) FILTER (WHERE status = 'missing'), ','), '') AS missing_skills, coalesce(array_to_string(list(skill ORDER BY ord) FILTER (WHERE status = 'invalid'), ','), '') AS invalid_summaries FROM runs GROUP BY 1),
 hl AS (SELECT *, CASE WHEN p = 0 OR (na = p AND g = 0) THEN 'not-applicable' WHEN b THEN 'blocked' WHEN g >= 3 THEN 'partial-coverage' WHEN y OR g > 0 THEN 'watch' ELSE 'healthy' END AS overall_health, CASE WHEN g = 0 THEN 'complete' ELSE 'partial' END AS coverage_status FROM ha)"""
_LINE = "CASE WHEN p = 0 THEN " + sql_text(C.HEALTH_LINES["none"]) + " ELSE CASE overall_health " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in C.HEALTH_LINES.items() if k != "none") + " END END"


@query("rollup_health", WITH + ",\n" + HEALTH + f" SELECT repo_id, overall_health, coverage_status, {_LINE} AS summary_line, missing_skills, invalid_summaries FROM hl")
def rollup_health(spark, sf):
    h = R.health(runs_of(spark, sf))
    return h.withColumns({c: F.array_join(c, ",") for c in ("missing_skills", "invalid_summaries")})


def action_sql(partial: str, bucket: str = "rollup_bucket") -> str:
    high = "CASE domain " + " ".join(f"WHEN '{d}' THEN {sql_text(t)}" for d, t in C.HIGH_ACTIONS.items()) + " END"
    watch = "CASE domain " + " ".join(f"WHEN '{d}' THEN {sql_text(t)}" for d, t in C.WATCH_ACTIONS.items()) + " END"
    return (
        "CASE WHEN dependency_status = 'blocked' THEN 'Unblock ' || skill || ' first: restore ' || CASE WHEN failure_name IS NOT NULL THEN '`' || failure_name || '` so the audit can run before trusting ' ELSE 'its runtime prerequisites before trusting ' END || domain || ' coverage.' "
        f"WHEN status IN ('missing', 'invalid') THEN CASE WHEN {partial} THEN {sql_text(C.COVERAGE_ACTION)} END WHEN status = 'not-applicable' THEN NULL WHEN {bucket} IN ('blocked', 'red') THEN {high} WHEN {bucket} = 'yellow' THEN {watch} END"
    )


@query(
    "rollup_recommended_actions",
    WITH + f""", ac AS (SELECT repo_id, ord, {action_sql('true')} AS a FROM runs), fa AS (SELECT repo_id, a, min(ord) AS o FROM ac WHERE a IS NOT NULL GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY o) AS rn FROM fa)
 SELECT r.repo_id, coalesce(array_to_string(list(a ORDER BY rn) FILTER (WHERE rn <= 5), ' | '), '') AS top_actions FROM (SELECT DISTINCT repo_id FROM runs) r LEFT JOIN rk USING (repo_id) GROUP BY 1""",
)
def rollup_recommended_actions(spark, sf):
    return R.recommended_actions(runs_of(spark, sf)).withColumn("top_actions", F.array_join("top_actions", " | "))


_LABEL = "CASE WHEN dependency_status = 'blocked' THEN 'dependency-blocked' WHEN status IN ('missing', 'invalid') THEN 'coverage-gap' WHEN status = 'not-applicable' OR rollup_bucket = 'not-applicable' THEN 'not-applicable' WHEN rollup_bucket IN ('blocked', 'red') THEN 'high-risk' WHEN lower(child_verdict) = 'triage' THEN 'trust-gap' WHEN rollup_bucket = 'yellow' THEN 'watch' ELSE 'stable' END"
_RANK = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.RISK_RANK.items()) + " END"
_WHY = "CASE risk_label " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in C.WHY_NOW.items()) + " END"
RECORDS = f"rec0 AS (SELECT *, {_LABEL} AS risk_label FROM runs), rec AS (SELECT *, {_RANK} AS risk_rank, {_WHY} AS why_now FROM rec0)"


@query(
    "rollup_risk",
    WITH + ",\n" + RECORDS + """ SELECT repo_id, domain, risk_label, CAST(risk_rank AS INTEGER) AS risk_rank, why_now, concat_ws(',', CASE WHEN status IN ('missing', 'invalid') THEN status || '-summary' END, CASE WHEN NOT has_report THEN 'missing-human-report' END, CASE WHEN NOT has_brief THEN 'missing-agent-brief' END) AS evidence_gaps FROM rec""",
)
def rollup_risk(spark, sf):
    r = R.domain_records(runs_of(spark, sf))
    return r.select("repo_id", "domain", "risk_label", "risk_rank", "why_now", F.array_join("evidence_gaps", ",").alias("evidence_gaps"))


@query(
    "rollup_unknowns",
    WITH + ",\n" + RECORDS + f""" SELECT repo_id, domain AS scope, 'missing-human-report' AS kind, 'human-report not produced at ' || domain || '/report.md' AS detail FROM rec WHERE NOT has_report
 UNION ALL SELECT repo_id, domain, 'missing-agent-brief', 'agent-brief not produced at ' || domain || '/agent-brief.md' FROM rec WHERE NOT has_brief
 UNION ALL SELECT repo_id, domain, 'trust-gap', {sql_text(C.TRUST_GAP)} FROM rec WHERE risk_label = 'trust-gap'""",
)
def rollup_unknowns(spark, sf):
    return R.unknowns(R.domain_records(runs_of(spark, sf)))


CLUSTERS = (
    "cu AS (SELECT repo_id, cluster, bool_and(status = 'not-applicable') AS na, bool_or(risk_label IN ('dependency-blocked', 'high-risk')) AS b, bool_or(risk_label IN ('watch', 'trust-gap', 'coverage-gap')) AS w, array_to_string(list(domain ORDER BY ord), ', ') AS names, min(ord) AS first_ord FROM rec GROUP BY 1, 2),\n"
    "cv AS (SELECT *, CASE WHEN na THEN 'not-applicable' WHEN b THEN 'blocked' WHEN w THEN 'watch' ELSE 'healthy' END AS status, CASE cluster " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in C.CLUSTERS.items()) + " END AS title FROM cu),\n"
    "ct AS (SELECT repo_id, cluster, array_to_string(list(c ORDER BY rn), ',') AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, cluster ORDER BY n DESC, o) AS rn FROM (SELECT repo_id, cluster, c, count(*) AS n, min(ord * 10 + rn) AS o FROM tc GROUP BY 1, 2, 3)) WHERE rn <= 4 GROUP BY 1, 2)"
)


@query(
    "rollup_clusters",
    WITH + ",\n" + RECORDS + ",\n" + CLUSTERS + """ SELECT cv.repo_id, cv.cluster, title, status, coalesce(top_categories, '') AS top_categories,
 CASE status WHEN 'blocked' THEN title || ' is the main blocker cluster right now, driven by ' || names || '.' WHEN 'watch' THEN title || ' still needs cleanup or stronger proof before ' || names || ' can be trusted as stable.'
 WHEN 'not-applicable' THEN title || ' is not currently in play for this repository.' ELSE title || ' shows no visible blocker from the current run across ' || names || '.' END AS summary
 FROM cv LEFT JOIN ct ON ct.repo_id = cv.repo_id AND ct.cluster = cv.cluster""",
)
def rollup_clusters(spark, sf):
    c = R.clusters(R.domain_records(runs_of(spark, sf)))
    return c.select("repo_id", "cluster", "title", "status", F.array_join("top_categories", ",").alias("top_categories"), "summary")


@query(
    "rollup_ordered_actions",
    WITH + ",\n" + RECORDS + ",\n" + HEALTH + f""", oa AS (SELECT repo_id, domain, cluster, risk_rank AS priority_rank, {action_sql('true')} AS action, why_now FROM rec),
 ob AS (SELECT * FROM oa WHERE action IS NOT NULL AND priority_rank < 8 UNION ALL SELECT repo_id, 'overall', 'cross-cutting', 4, {sql_text(C.COVERAGE_GAP_ACTION)}, {sql_text(C.COVERAGE_GAP_WHY)} FROM hl WHERE coverage_status = 'partial'),
 oc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, action ORDER BY priority_rank, domain) AS s FROM ob) WHERE s = 1)
 SELECT repo_id, domain, cluster, CAST(priority_rank AS INTEGER) AS priority_rank, action, why_now, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY priority_rank, domain, action) AS INTEGER) AS priority,
 CASE WHEN priority_rank <= 1 THEN 'now' WHEN priority_rank <= 3 THEN 'next' ELSE 'later' END AS tier FROM oc""",
)
def rollup_ordered_actions(spark, sf):
    # written once: records and health both read it
    runs = stage(runs_of(spark, sf), "runs")
    return R.ordered_actions(R.domain_records(runs), R.health(runs))


@query(
    "rollup_teaching_line",
    WITH + ",\n" + RECORDS + ",\n" + CLUSTERS + " SELECT repo_id, CASE min_by(cluster, first_ord) FILTER (WHERE status = 'blocked') " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in C.TEACHING.items())
    + f" ELSE CASE WHEN bool_or(status = 'watch') THEN {sql_text(C.TEACHING_WATCH)} ELSE {sql_text(C.TEACHING_OK)} END END AS teaching_line FROM cv GROUP BY 1",
)
def rollup_teaching_line(spark, sf):
    return R.teaching_line(R.clusters(R.domain_records(runs_of(spark, sf))))


@query(
    "rollup_final_state",
    WITH + """ SELECT repo_id, domain, runtime_status, upper(replace(runtime_status, '-', ' ')) AS status_label, detail FROM (SELECT *,
 CASE WHEN status = 'blocked' OR dependency_status = 'blocked' THEN 'blocked' WHEN status = 'present' THEN CASE WHEN rollup_bucket IN ('blocked', 'red') THEN 'blocked' ELSE 'complete' END WHEN status IN ('not-applicable', 'invalid') THEN status ELSE 'missing' END AS runtime_status,
 CASE WHEN status = 'blocked' OR dependency_status = 'blocked' THEN coalesce(failure_name, CASE WHEN child_verdict = '' THEN 'dependency bootstrap blocked' ELSE child_verdict END)
 WHEN status = 'present' THEN CASE WHEN child_verdict <> '' THEN child_verdict WHEN rollup_bucket IN ('blocked', 'red') THEN 'high-risk findings' ELSE 'artifact ready' END WHEN status = 'not-applicable' THEN 'domain not applicable'
 WHEN status = 'invalid' THEN CASE WHEN child_verdict = '' THEN 'summary failed validation' ELSE child_verdict END ELSE 'artifact missing' END AS detail FROM runs)""",
)
def rollup_final_state(spark, sf):
    return R.final_state(runs_of(spark, sf))


@query("rollup_final_tone", WITH + ",\n" + HEALTH + " SELECT repo_id, CASE overall_health " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.TONES.items()) + " END AS state_tone, CASE overall_health " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.TONES.items()) + " END AS state_label FROM hl")
def rollup_final_tone(spark, sf):
    return R.final_tone(R.health(runs_of(spark, sf)))


EXCERPT = r"""SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 319)) || '…' END AS excerpt FROM (
 SELECT d.doc_id, coalesce(trim(string_agg(trim(CASE WHEN starts_with(s, '- ') THEN substr(s, 3) ELSE s END), ' ' ORDER BY n) FILTER (WHERE rn <= 3)), '') AS t FROM files d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM (
   SELECT *, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM (
    SELECT doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM files))))
  WHERE fences % 2 = 0 AND s <> '' AND NOT starts_with(s, '```') AND NOT starts_with(s, '#') AND NOT starts_with(s, '|')) x ON x.doc_id = d.doc_id GROUP BY 1)"""


@query("report_excerpts", "WITH " + D.files_cte() + "\n" + EXCERPT)
def report_excerpts(spark, sf):
    return D.corpus(spark, sf).select("doc_id", R.compact_excerpt(F.col("text")).alias("excerpt"))


@query(
    "verdict_buckets",
    "WITH " + ", ".join([D.summaries_cte(), "vc(domain, verdict, bucket) AS (VALUES " + ", ".join(f"('{d}', '{v}', '{b}')" for d, m in C.VERDICT_BUCKETS.items() for v, b in m.items()) + ")"])
    + ", pv AS (SELECT sk.*, (list_sort(vs))[k % len(vs) + 1] AS verdict FROM sk JOIN (SELECT domain, list(verdict) AS vs FROM vc GROUP BY 1) USING (domain)) SELECT repo_id, domain, verdict, bucket FROM pv JOIN vc USING (domain, verdict)",
)
def verdict_buckets(spark, sf):
    """Verdict to bucket lookup: the contract table is small by construction and looked up as a literal map."""
    keys = D.summary_keys(spark, sf)
    options = F.create_map(*[x for d, m in C.VERDICT_BUCKETS.items() for x in (F.lit(d), F.array(*[F.lit(v) for v in sorted(m)]))])
    vs = options[F.col("domain")]
    verdict = F.element_at(vs, (F.col("k") % F.size(vs) + 1).cast("int"))
    return keys.select("repo_id", "domain", verdict.alias("verdict")).withColumn("bucket", R.bucket_of(F.col("domain"), F.col("verdict")))
