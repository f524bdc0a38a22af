"""Queries over sources, cleanup rules and side effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.operators.findings import category_counts, join_evidence, severity_counts
from repoaudit.plans import cleanup, side_effects
from repoaudit.queries import sqlgen as S
from repoaudit.queries.derived import corpus
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import rx, surface_where, with_files
from repoaudit.rules import cleanup as CR
from repoaudit.rules import side_effects as SR
from repoaudit.sources.corpus import repositories

AS_OF = "2025-06-30"



def shown(found, *extra):
    """Flat comparable columns of findings."""
    return found.select(
        "repo_id", "path", "category", "severity", "confidence", "title",
        F.coalesce("line", F.lit(0)).alias("line"), join_evidence().alias("evidence"), *extra,
    )


CLEAN_CTE = f"""c AS (SELECT repo_id, path, text, code, {S.SUFFIX} AS sfx,
  {S.extract_first('text', CR.REPLACEMENT)} AS replacement,
  {S.extract_first('text', CR.REMOVAL_TARGET)} AS target,
  {S.extract_first('text', CR.DEPRECATION)} AS cue,
  code AND {rx('path', CR.SHIM_PATH)} AS shim_path,
  CASE WHEN code THEN {S.extract_first('text', CR.SHIM_TEXT)} END AS shim_cue,
  CASE WHEN code THEN {S.extract_first('text', CR.FEATURE_FLAG)} END AS flag_cue,
  CASE WHEN code THEN {S.extract_first('text', CR.DYNAMIC_ENTRY)} END AS dynamic_cue
 FROM (SELECT *, {S.SUFFIX} NOT IN ('.md', '.mdx', '.rst', '.txt', '.adoc') AS code FROM files WHERE {surface_where('cleanup')})),
 m AS (SELECT *, cue IS NOT NULL OR target IS NOT NULL AS marked, coalesce(cue, target) AS shown,
  concat_ws(', ', CASE WHEN coalesce(replacement, '') = '' THEN 'replacement' END, CASE WHEN coalesce(target, '') = '' THEN 'removal target' END) AS gaps,
  code AND shim_cue IS NOT NULL AND (shim_path OR cue IS NOT NULL OR target IS NOT NULL) AS is_shim FROM c),
 found AS (
  SELECT repo_id, path, 'deprecated-surface' AS category, 'medium' AS severity, CASE WHEN cue IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence,
   {S.sql_text(CR.TITLES['deprecated-surface'])} AS title, {S.line_of('text', 'shown')} AS line, 'matched cue: ' || shown AS evidence FROM m WHERE marked
  UNION ALL SELECT repo_id, path, 'compatibility-shim', 'medium', CASE WHEN shim_path THEN 'medium' ELSE 'low' END, {S.sql_text(CR.TITLES['compatibility-shim'])}, {S.line_of('text', 'shim_cue')},
   CASE WHEN shim_path THEN 'path suggests compatibility surface: ' || path || ' | ' ELSE '' END || 'matched cue: ' || shim_cue FROM m WHERE is_shim
  UNION ALL SELECT repo_id, path, 'cleanup-opportunity', 'low', 'low', {S.sql_text(CR.TITLES['cleanup-opportunity'])}, NULL, 'path suggests compatibility surface: ' || path
   FROM m WHERE NOT coalesce(is_shim, false) AND shim_path AND NOT marked
  UNION ALL SELECT repo_id, path, 'expired-removal-target', 'high', 'high', {S.sql_text(CR.TITLES['expired-removal-target'])}, {S.line_of('text', 'target')}, 'expired removal target: ' || target
   FROM m WHERE regexp_matches(target, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST(target AS DATE) < DATE '{AS_OF}'
  UNION ALL SELECT repo_id, path, 'marker-gap', 'medium', 'medium', {S.sql_text(CR.TITLES['marker-gap'])} || gaps || '.', {S.line_of('text', 'cue')}, 'deprecation cue without complete machine-readable metadata'
   FROM m WHERE marked AND gaps <> ''
  UNION ALL SELECT repo_id, path, 'feature-flag-debt', 'medium', 'medium', {S.sql_text(CR.TITLES['feature-flag-debt'])}, {S.line_of('text', 'flag_cue')}, 'matched cue: ' || flag_cue FROM m WHERE flag_cue IS NOT NULL
  UNION ALL SELECT repo_id, path, 'dynamic-entrypoint-risk', 'high', 'medium', {S.sql_text(CR.TITLES['dynamic-entrypoint-risk'])}, {S.line_of('text', 'dynamic_cue')}, 'matched cue: ' || dynamic_cue FROM m WHERE dynamic_cue IS NOT NULL)"""

GAP_CTE = f"""gflags AS (SELECT repo_id,
  bool_or(string_split(path, '/')[1] IN {S.sql_in(CR.TEST_DIRS)} OR path LIKE '.github/workflows/%') AS tests,
  bool_or(path LIKE '.github/workflows/%') AS ci FROM files GROUP BY repo_id),
 gaps AS (SELECT repo_id, '.' AS path, 'evidence-gap' AS category, 'high' AS severity, 'high' AS confidence, {S.sql_text(CR.TITLES['no-tests'])} AS title, 0 AS line, 'no tests/ or common test-runner manifest found' AS evidence FROM gflags WHERE NOT tests
  UNION ALL SELECT repo_id, '.', 'evidence-gap', 'medium', 'medium', {S.sql_text(CR.TITLES['no-ci'])}, 0, 'no common CI config found' FROM gflags WHERE NOT ci
  UNION ALL SELECT repo_id, '.', 'scan-blocker', 'medium', 'medium', {S.sql_text(CR.TITLES['no-manifests'])}, 0, 'no known manifest files found' FROM gflags WHERE NOT ci)"""

FOUND_COLS = "repo_id, path, category, severity, confidence, title, CAST(coalesce(line, 0) AS INTEGER) AS line, evidence"


@query("cleanup_findings", with_files(CLEAN_CTE, select=f"SELECT {FOUND_COLS} FROM found"))
def cleanup_findings(spark, sf):
    return shown(cleanup.detect_files(corpus(spark, sf), AS_OF))


@query(
    "cleanup_verdict",
    with_files(
        CLEAN_CTE,
        GAP_CTE,
        select=f"""SELECT r.repo_id, {S.severity_sql()}, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 OR count(*) FILTER (WHERE severity = 'high') >= 2 THEN 'not-ready'
 WHEN count(*) FILTER (WHERE severity = 'high') = 1 OR count(*) FILTER (WHERE severity = 'medium') > 0 THEN 'partially-ready' ELSE 'ready-for-controlled-deletion' END AS verdict
 FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN (SELECT repo_id, severity FROM found UNION ALL SELECT repo_id, severity FROM gaps) f USING (repo_id) GROUP BY 1""",
    ),
)
def cleanup_verdict(spark, sf):
    files = corpus(spark, sf)
    counts = severity_counts(cleanup.detect(files, AS_OF), repositories(files))
    return counts.select("repo_id", "critical", "high", "medium", "low", cleanup.verdict().alias("verdict"))


@query(
    "cleanup_category_counts",
    with_files(CLEAN_CTE, select="SELECT repo_id, category, count(*) AS n FROM found GROUP BY 1, 2"),
)
def cleanup_category_counts(spark, sf):
    return category_counts(cleanup.detect_files(corpus(spark, sf), AS_OF))


@query(
    "cleanup_removal_gate",
    with_files(
        CLEAN_CTE,
        select=f"""SELECT repo_id, count(*) FILTER (WHERE e) AS expired, count(*) FILTER (WHERE i) AS incomplete,
 count(*) FILTER (WHERE e) > 0 OR count(*) FILTER (WHERE i) > 0 AS gate_failed FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN (
 SELECT m.repo_id, found.category = 'expired-removal-target' OR (found.category <> 'dynamic-entrypoint-risk' AND coalesce(regexp_matches(target, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST(target AS DATE) < DATE '{AS_OF}', false)) AS e,
  found.category IN ('deprecated-surface', 'compatibility-shim', 'marker-gap') AND gaps <> '' AS i
 FROM found JOIN m ON found.repo_id = m.repo_id AND found.path = m.path) USING (repo_id) GROUP BY 1""",
    ),
)
def cleanup_removal_gate(spark, sf):
    return cleanup.removal_gate(cleanup.detect_files(corpus(spark, sf), AS_OF), AS_OF, repositories(corpus(spark, sf)), strict=True)


# ---- side effects -----------------------------------------------------------------------------------------------

SE_SURFACE = f"src AS (SELECT * FROM files WHERE {surface_where('distributed-side-effects')} AND text <> '')"
SE_FLAGS = f"""fflags AS (SELECT repo_id, path, {rx('text', SR.EFFECT)} AS effect,
  {', '.join(f"{rx('text', b)} AS {k}" for k, b in SR.FLAG_BANKS.items())},
  {rx('text', SR.EFFECT)} OR {rx('text', SR.COMMIT)} OR {rx('text', SR.CONSUMER)} OR lower(text) LIKE '%webhook%' OR lower(text) LIKE '%queue%' OR lower(text) LIKE '%event%' AS relevant FROM src),
 rflags AS (SELECT repo_id, {', '.join(f'bool_or({k}) AS {k}' for k in SR.FLAG_BANKS)}, bool_or(effect) AS has_effect,
  count(*) FILTER (WHERE relevant) AS relevant_signals, count(*) AS files_scanned FROM fflags GROUP BY 1)"""
SE_LINES = f"""sl AS (SELECT repo_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM src)),
 hl AS (SELECT *, {rx('line', SR.COMMIT)} AS cm, {rx('line', SR.EFFECT)} AS ef, {rx('line', SR.RETRY)} AS rt, {rx('line', SR.CONSUMER)} AS co, {rx('line', SR.MUTATION)} AS mu FROM sl),
 starts AS (SELECT repo_id, path, unnest(range(0, max(n), 10)) AS s FROM sl GROUP BY repo_id, path),
 win AS (SELECT s.repo_id, s.path, s.s, min(CASE WHEN cm THEN n END) AS c, min(CASE WHEN ef THEN n END) AS e, min(CASE WHEN rt THEN n END) AS r,
  string_agg(line, chr(10) ORDER BY n) AS chunk FROM starts s JOIN hl ON s.repo_id = hl.repo_id AND s.path = hl.path AND n > s AND n <= s + 40 GROUP BY 1, 2, 3),
 wf AS (SELECT w.*, {rx('chunk', SR.OUTBOX)} AS ob, {rx('chunk', SR.RETRY)} AND {rx('chunk', SR.EFFECT)} AND NOT {rx('chunk', SR.IDEMPOTENCY)} AS ur,
  lc.line AS ct, le.line AS et FROM win w LEFT JOIN sl lc ON w.repo_id = lc.repo_id AND w.path = lc.path AND lc.n = w.c LEFT JOIN sl le ON w.repo_id = le.repo_id AND w.path = le.path AND le.n = w.e),
 cons AS (SELECT repo_id, path, coalesce(min(CASE WHEN co THEN n END), min(CASE WHEN mu THEN n END), 1) AS n FROM hl GROUP BY 1, 2),
 raw AS (
  SELECT repo_id, path, 'pre-commit-side-effect' AS category, 'critical' AS severity, 'high' AS confidence, {S.sql_text(SR.TITLES['pre-commit-side-effect'])} AS title, e AS line, {S.strip('et')} || ' | ' || {S.strip('ct')} AS evidence FROM wf WHERE e < c
  UNION SELECT repo_id, path, 'dual-write-hazard', 'high', 'high', {S.sql_text(SR.TITLES['dual-write-hazard'])}, c, {S.strip('ct')} || ' | ' || {S.strip('et')} FROM wf WHERE e >= c
  UNION SELECT repo_id, path, 'outbox-gap', 'high', 'medium', {S.sql_text(SR.TITLES['outbox-gap'])}, c, 'commit + side effect detected | no local outbox / relay keyword detected in the surrounding flow' FROM wf JOIN rflags USING (repo_id) WHERE e >= c AND NOT ob AND NOT outbox
  UNION SELECT wf.repo_id, wf.path, 'unsafe-retry', 'high', 'medium', {S.sql_text(SR.TITLES['unsafe-retry'])}, coalesce(r, s + 1), {S.strip('sl.line')} FROM wf JOIN sl ON wf.repo_id = sl.repo_id AND wf.path = sl.path AND sl.n = coalesce(r, s + 1) WHERE ur
  UNION SELECT src.repo_id, src.path, 'idempotency-gap', 'high', 'medium', {S.sql_text(SR.TITLES['idempotency-gap'])}, cons.n, {S.strip('sl.line')} FROM src JOIN cons USING (repo_id, path) JOIN sl ON src.repo_id = sl.repo_id AND src.path = sl.path AND sl.n = cons.n JOIN rflags ON rflags.repo_id = src.repo_id
   WHERE ({rx('text', SR.CONSUMER)} OR regexp_matches(lower(src.path), 'consumer|handler|listener|subscriber|webhook')) AND {rx('text', SR.MUTATION)} AND NOT {rx('text', SR.IDEMPOTENCY)} AND NOT idempotency
  UNION SELECT repo_id, '.', 'dead-letter-gap', 'medium', 'medium', {S.sql_text(SR.TITLES['dead-letter-gap'])}, 1, 'message / handler signals detected | no DLQ / dead-letter keyword found repo-wide' FROM rflags WHERE relevant_signals > 0 AND has_effect AND NOT dead_letter
  UNION SELECT repo_id, '.', 'event-contract-gap', 'medium', 'low', {S.sql_text(SR.TITLES['event-contract-gap'])}, 1, 'event / publish signals detected | no obvious version field or version marker found repo-wide' FROM rflags WHERE relevant_signals > 0 AND has_effect AND NOT event_versioning
  UNION SELECT repo_id, '.', 'observability-gap', 'low', 'low', {S.sql_text(SR.TITLES['observability-gap'])}, 1, 'side-effect signals detected | no obvious trace_id / correlation_id / telemetry signal found repo-wide' FROM rflags WHERE relevant_signals > 0 AND has_effect AND NOT observability)"""


@query("side_effect_repo_flags", with_files(SE_SURFACE, SE_FLAGS, select="SELECT * FROM rflags"))
def side_effect_repo_flags(spark, sf):
    return side_effects.repo_flags(side_effects.file_signals(corpus(spark, sf)))


@query("side_effect_findings", with_files(SE_SURFACE, SE_FLAGS, SE_LINES, select=f"SELECT {FOUND_COLS} FROM raw"))
def side_effect_findings(spark, sf):
    return shown(side_effects.audit(corpus(spark, sf))[0])


@query(
    "side_effect_verdict",
    with_files(
        SE_SURFACE, SE_FLAGS, SE_LINES,
        select=f"""SELECT r.repo_id, {S.severity_sql()}, CASE WHEN any_value(relevant_signals) IS NULL OR any_value(relevant_signals) = 0 THEN 'not-applicable'
 WHEN count(*) FILTER (WHERE f.severity = 'critical') > 0 OR count(*) FILTER (WHERE f.severity = 'high') >= 2 THEN 'unsafe'
 WHEN count(*) FILTER (WHERE f.severity = 'high') = 1 OR count(*) FILTER (WHERE f.severity = 'medium') >= 2 THEN 'fragile'
 WHEN count(f.severity) > 0 THEN 'watch' WHEN any_value(outbox::INT + idempotency::INT + dead_letter::INT + event_versioning::INT + observability::INT) >= 4 THEN 'hardened' ELSE 'sound' END AS verdict
 FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN rflags USING (repo_id) LEFT JOIN raw f ON f.repo_id = r.repo_id GROUP BY 1""",
    ),
)
def side_effect_verdict(spark, sf):
    verdicts = side_effects.audit(corpus(spark, sf))[1]
    return verdicts.select("repo_id", "critical", "high", "medium", "low", "verdict")


