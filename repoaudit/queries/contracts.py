"""Queries over error contracts, tool runs, dependency structure, contract gates and durable agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.operators import tool_runs as T
from repoaudit.operators.facts import python_facts
from repoaudit.plans import contract_gates as CG
from repoaudit.plans import durable_agents as DA
from repoaudit.plans import error_contract as EC
from repoaudit.plans import side_effects as SE
from repoaudit.plans import structure as ST
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.base import FOUND_COLS, shown
from repoaudit.queries.derived import corpus
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import rx, sql_text, surface_where, with_files
from repoaudit.rules import contract_gates as CR
from repoaudit.rules import durable_agents as DR
from repoaudit.rules import error_contract as R
from repoaudit.rules.api_surfaces import MANAGERS
from repoaudit.rules.surface import PACKAGE_MANAGERS
from repoaudit.sources.corpus import repositories, select_surface

# ---- error contract ---------------------------------------------------------------------------------------------

SFX = S.SUFFIX
STRUCTURED = f"{SFX} IN {S.sql_in(R.STRUCTURED_SUFFIXES)}"
CODE = f"{SFX} IN {S.sql_in(R.CODE_SUFFIXES)}"
FLAGS = {
    "n_openapi": f"{rx('path', R.OPENAPI)} OR ({STRUCTURED} AND {rx('text', R.OPENAPI)})",
    "n_asyncapi": f"{rx('path', R.ASYNCAPI)} OR ({STRUCTURED} AND {rx('text', R.ASYNCAPI)})",
    "n_catalog": rx("path", R.PATHS["catalog"]),
    "n_generated": f"{rx('path', R.PATHS['generated'])} AND {rx('text', R.CODEGEN_HINT)}",
    "n_handler": f"{CODE} AND {rx('path', R.PATHS['handler'])}",
    "n_doc_claims": f"{SFX} IN {S.sql_in(R.DOC_SUFFIXES)} AND {rx('text', R.DOC_CLAIM)}",
    **{f"core_{k}": rx("text", p) for k, p in R.CORE_FIELDS.items()},
    **{f"ext_{k}": rx("text", p) for k, p in R.EXTENSION_FIELDS.items()},
}
BOOLS = {
    **{f"fw_{k}": rx("text", p) for k, p in R.FRAMEWORKS.items()},
    "problem_media": rx("text", R.PROBLEM_MEDIA),
    "async_structured": rx("text", R.ASYNC_STRUCTURED),
    "global_handler": rx("text", R.GLOBAL_HANDLER),
    "ci_guard": f"(lower(path) LIKE '%.github/workflows/%' OR regexp_matches(lower(path), 'pre-commit-config\\.ya?ml$')) AND {rx('text', R.CI_GUARD)}",
    "l_python": f"{SFX} IN ('.py', '.pyi')",
    "l_typescript": f"{SFX} IN ('.ts', '.tsx')",
    "l_javascript": f"{SFX} IN ('.js', '.jsx', '.mjs', '.cjs')",
}
EC_CTES = [
    f"src AS (SELECT * FROM files WHERE {surface_where('error-governance')} AND text <> '')",
    "rows AS (SELECT r.repo_id, coalesce(files_scanned, 0) AS files_scanned, "
    + ", ".join(f"coalesce({k}, 0) AS {k}" for k in FLAGS)
    + ", "
    + ", ".join(f"coalesce({k}, false) AS {k}" for k in BOOLS)
    + " FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN (SELECT repo_id, count(*) AS files_scanned, "
    + ", ".join(f"count(*) FILTER (WHERE {e}) AS {k}" for k, e in FLAGS.items())
    + ", "
    + ", ".join(f"bool_or({e}) AS {k}" for k, e in BOOLS.items())
    + " FROM src GROUP BY 1) c USING (repo_id))",
    "pc AS (SELECT * FROM src WHERE " + CODE + " AND '/' || lower(path) NOT LIKE '%/tests/%' AND NOT contains(lower(" + S.NAME + "), 'test_'))",
    "pl AS (SELECT repo_id, path, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT *, string_split(text, chr(10)) AS ls FROM pc))",
]


def _first(category: str, rules, extra: str = "true") -> str:
    severity, confidence, title, _, _ = R.FILE_FINDINGS[category]
    return (
        f"SELECT repo_id, path, '{category}' AS category, '{severity}' AS severity, '{confidence}' AS confidence, {sql_text(title)} AS title, n AS line, "
        f"{S.strip('line')} AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY n) AS rn FROM pl WHERE {rx('line', rules)} AND {extra}) WHERE rn = 1"
    )


def _repo(category: str) -> str:
    severity, confidence, _, title, evidence, _, _ = R.REPO_FINDINGS[category]
    sev, ttl, evd = sql_text(severity), sql_text(title), sql_text(evidence)
    if category == "ssot-missing":
        pick = lambda hard, soft: f"CASE WHEN {R.SSOT_IS_HIGH} THEN {hard} ELSE {sql_text(soft)} END"
        sev, ttl, evd = (pick(h, s) for h, s in zip((sev, ttl, evd), R.SSOT_SOFT))
    return (
        f"SELECT repo_id, '.' AS path, '{category}' AS category, {sev} AS severity, '{confidence}' AS confidence, {ttl} AS title, 1 AS line, {evd} AS evidence "
        f"FROM rows WHERE {R.CONDITIONS[category]}"
    )


EC_FOUND = "found AS (" + " UNION ALL ".join(
    [
        _first("text-branching", R.TEXT_BRANCH),
        _first("leakage-risk", R.LEAKAGE, rx("text", R.OUTWARD)),
        _first("numeric-or-vague-code", R.NUMERIC_CODE),
    ]
    + [_repo(c) for c in R.REPO_FINDINGS]
) + ")"
EC_VERDICT = (
    "v AS (SELECT r.*, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(total, 0) AS total, "
    + ", ".join(f"coalesce({c.replace('-', '_')}, false) AS {c.replace('-', '_')}" for c in EC.ALL_CATEGORIES)
    + " FROM rows r LEFT JOIN (SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total, "
    + ", ".join(f"bool_or(category = '{c}') AS {c.replace('-', '_')}" for c in EC.ALL_CATEGORIES)
    + " FROM found GROUP BY 1) f USING (repo_id))"
)


@query("error_contract_counters", with_files(*EC_CTES[:2], select="SELECT * FROM rows"))
def error_contract_counters(spark, sf):
    rows = EC.counters(EC.file_signals(corpus(spark, sf)), repositories(corpus(spark, sf)))
    return rows.select("repo_id", "files_scanned", *FLAGS, *BOOLS)


@query("error_contract_findings", with_files(*EC_CTES, EC_FOUND, select=f"SELECT {FOUND_COLS} FROM found"))
def error_contract_findings(spark, sf):
    return shown(EC.audit(corpus(spark, sf))[0])


@query("error_contract_verdict", with_files(*EC_CTES, EC_FOUND, EC_VERDICT, select=f"SELECT repo_id, {R.VERDICT} AS verdict FROM v"))
def error_contract_verdict(spark, sf):
    return EC.audit(corpus(spark, sf))[1].select("repo_id", "verdict")


@query(
    "error_contract_gates",
    with_files(*EC_CTES, EC_FOUND, EC_VERDICT, select=" UNION ALL ".join(f"SELECT repo_id, '{g}' AS gate, {e} AS state FROM v" for g, e in R.GATES.items())),
)
def error_contract_gates(spark, sf):
    return EC.gate_states(EC.audit(corpus(spark, sf))[1])


@query(
    "error_contract_profile",
    with_files(
        *EC_CTES[:2],
        select="SELECT repo_id, array_to_string(list_filter([CASE WHEN l_javascript THEN 'javascript' END, CASE WHEN l_python THEN 'python' END, CASE WHEN l_typescript THEN 'typescript' END], lambda x: x IS NOT NULL), ',') AS languages, "
        "array_to_string(list_filter([" + ", ".join(f"CASE WHEN fw_{k} THEN '{k}' END" for k in sorted(R.FRAMEWORKS)) + "], lambda x: x IS NOT NULL), ',') AS frameworks, "
        "array_to_string(list_filter([CASE WHEN n_asyncapi > 0 THEN 'async' END, CASE WHEN n_openapi > 0 OR n_handler > 0 THEN 'http' END], lambda x: x IS NOT NULL), ',') AS protocols FROM rows",
    ),
)
def error_contract_profile(spark, sf):
    p = EC.profile(EC.counters(EC.file_signals(corpus(spark, sf)), repositories(corpus(spark, sf))))
    return p.select("repo_id", *[F.array_join(c, ",").alias(c) for c in ("languages", "frameworks", "protocols")])


# ---- tool runs and structure ------------------------------------------------------------------------------------

RUNS = "WITH " + D.tool_runs_cte() + ", " + D.merged_runs_cte() + "\n"


@query("tool_runs_merged", RUNS + "SELECT repo_id, tool, status, command, exit_code, issue_count, summary, array_to_string(details, ' | ') AS details FROM merged")
def tool_runs_merged(spark, sf):
    m = T.merge_tool_runs(D.tool_runs(spark, sf))
    return m.withColumn("details", F.array_join("details", " | "))


@query(
    "tool_run_details",
    "WITH " + D.tool_runs_cte() + ", fl AS (SELECT repo_id, tool, batch, unnest(details) AS detail, generate_subscripts(details, 1) AS i FROM tool_runs) "
    "SELECT repo_id, tool, CAST(row_number() OVER (PARTITION BY repo_id, tool ORDER BY batch, i, detail) AS INTEGER) AS seq, detail FROM fl",
)
def tool_run_details(spark, sf):
    return T.tool_details(D.tool_runs(spark, sf))


TOTALS = """iss AS (SELECT repo_id, tool, unnest(CAST(json_extract(payload, '$.issues') AS JSON[])) AS j FROM tool_runs WHERE json_valid(payload)),
 tot AS (SELECT repo_id, tool, key, sum(json_array_length(json_extract(j, '$.' || key))) AS total FROM (SELECT *, unnest(json_keys(j)) AS key FROM iss) WHERE key <> 'file' GROUP BY 1, 2, 3)"""


@query("tool_payload_totals", "WITH " + D.tool_runs_cte() + ", " + TOTALS + " SELECT repo_id, tool, key, CAST(total AS BIGINT) AS total FROM tot")
def tool_payload_totals(spark, sf):
    return T.issue_totals(D.tool_runs(spark, sf))


def _tool_arm(cond: str, cat: str, sev: str, conf: str, title: str, evidence: str = "summary") -> str:
    return f"SELECT repo_id, '.' AS path, {cat} AS category, {sev} AS severity, '{conf}' AS confidence, {sql_text(title)} AS title, 0 AS line, {evidence} AS evidence FROM tw WHERE {cond}"


_BAD = "(status = 'failed' OR contains(lower(array_to_string(details, ' ')), 'configuration file not found'))"
_KNIP = "tool = 'knip' AND status = 'issues' AND "
ST_FOUND = (
    "kt AS (SELECT repo_id, sum(total) FILTER (WHERE key = 'files') AS t_files, sum(total) FILTER (WHERE key = 'dependencies') AS t_dep, sum(total) FILTER (WHERE key IN "
    + S.sql_in(ST.EXPORT_KEYS)
    + ") AS t_exp, sum(total) FILTER (WHERE key IN ('unresolved', 'unlisted')) AS t_un FROM tot WHERE tool = 'knip' GROUP BY 1),\n"
    "circ AS (SELECT repo_id, tool, bool_or(contains(lower(payload), 'circular')) AS circular FROM tool_runs GROUP BY 1, 2),\n"
    "tw AS (SELECT m.*, circular, kt.* EXCLUDE (repo_id) FROM merged m JOIN circ USING (repo_id, tool) LEFT JOIN kt ON kt.repo_id = m.repo_id AND m.tool = 'knip'),\n"
    "found AS ("
    + " UNION ALL ".join(
        [
            _tool_arm(f"tool = 'tach' AND {_BAD}", "'config-gap'", "'high'", "high", "Python boundary governance is not runnable yet"),
            _tool_arm(f"tool = 'tach' AND NOT {_BAD} AND status = 'issues'", "'architecture-violation'", "'high'", "high", "Tach reported Python boundary or interface violations"),
            _tool_arm("tool = 'dependency-cruiser' AND status = 'failed'", "'config-gap'", "'medium'", "high", "Dependency Cruiser did not complete successfully"),
            _tool_arm("tool = 'dependency-cruiser' AND status = 'issues'", "CASE WHEN circular THEN 'cycle' ELSE 'architecture-violation' END", "CASE WHEN circular THEN 'high' ELSE 'medium' END", "medium", "Dependency Cruiser reported JS/TS graph violations"),
            _tool_arm("tool = 'knip' AND status = 'failed'", "'config-gap'", "'medium'", "high", "Knip did not complete successfully"),
            _tool_arm(_KNIP + "t_files > 0", "'unused-file'", "'medium'", "high", "Knip reported unused files", "'Knip reported ' || t_files || ' unused file finding(s).'"),
            _tool_arm(_KNIP + "t_dep > 0", "'unused-dependency'", "'medium'", "high", "Knip reported unused dependencies", "'Knip reported ' || t_dep || ' unused dependency finding(s).'"),
            _tool_arm(_KNIP + "t_exp > 0", "'unused-export'", "'low'", "medium", "Knip reported unused exports", "'Knip reported ' || t_exp || ' unused export finding(s).'"),
            _tool_arm(_KNIP + "t_un > 0", "'unresolved-import'", "'high'", "high", "Knip reported unresolved or unlisted imports", "'Knip reported ' || t_un || ' unresolved / unlisted dependency finding(s).'"),
        ]
    )
    + ")"
)


@query("structure_tool_findings", RUNS.rstrip() + ",\n" + TOTALS + ",\n" + ST_FOUND + f" SELECT {FOUND_COLS} FROM found")
def structure_tool_findings(spark, sf):
    runs = D.tool_runs(spark, sf)
    return shown(ST.tool_findings(T.merge_tool_runs(runs), runs))


@query(
    "structure_verdict",
    RUNS.rstrip() + ",\n" + TOTALS + ",\n" + ST_FOUND
    + """ SELECT r.repo_id, CASE WHEN count(*) FILTER (WHERE category = 'scan-blocker' OR severity = 'high') > 0 THEN 'scan-blocked' WHEN count(*) FILTER (WHERE category = 'config-gap') >= 2 THEN 'baseline-needed'
 WHEN count(*) FILTER (WHERE category LIKE 'unused-%') > 0 THEN 'cleanup-first' WHEN count(*) FILTER (WHERE category IN ('architecture-violation', 'cycle')) > 0 THEN 'boundary-hardening'
 WHEN count(category) > 0 THEN 'incremental-governance' ELSE 'well-governed' END AS verdict FROM (SELECT DISTINCT repo_id FROM tool_runs) r LEFT JOIN found USING (repo_id) GROUP BY 1""",
)
def structure_verdict(spark, sf):
    runs = D.tool_runs(spark, sf)
    return ST.verdict_rows(ST.tool_findings(T.merge_tool_runs(runs), runs), runs)


ST_SRC = f"src AS (SELECT * FROM files WHERE {surface_where('structure')})"
_PARTS = "string_split(path, '/')"
_ROOT = (
    f"CASE WHEN {_PARTS}[1] IN {S.sql_in(['packages', 'apps', 'libs', 'services', 'modules'])} AND len({_PARTS}) >= 3 AND {_PARTS}[3] = 'src' THEN array_to_string({_PARTS}[:3], '/') "
    f"WHEN {_PARTS}[1] IN {S.sql_in(['packages', 'apps', 'libs', 'services', 'modules'])} AND len({_PARTS}) >= 2 THEN array_to_string({_PARTS}[:2], '/') "
    f"WHEN {_PARTS}[1] = 'src' THEN 'src' WHEN {_PARTS}[1] IN ('tests', 'test', 'docs', '.github', 'scripts') THEN NULL WHEN {CODE} THEN {_PARTS}[1] END"
)


@query("structure_source_roots", with_files(ST_SRC, select=f"SELECT DISTINCT repo_id, root, side FROM (SELECT repo_id, {_ROOT} AS root, CASE WHEN {SFX} IN ('.py', '.pyi') THEN 'python' WHEN {CODE} THEN 'js' END AS side FROM src) WHERE root IS NOT NULL"))
def structure_source_roots(spark, sf):
    return ST.source_roots(corpus(spark, sf))


@query(
    "structure_profile",
    with_files(
        ST_SRC,
        f"x AS (SELECT repo_id, path, {_ROOT} AS root, CASE WHEN {SFX} IN ('.py', '.pyi') THEN 'python' WHEN {SFX} IN ('.ts', '.tsx') THEN 'typescript' WHEN {CODE} THEN 'javascript' END AS lang, {S.NAME} AS nm FROM src)",
        select="SELECT repo_id, coalesce(array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)), ','), 'non-application') AS languages, count(DISTINCT root) AS n_source_roots, "
        "CASE WHEN count(root) > 0 THEN 'single-package' ELSE 'repo-without-app-surface' END AS shape FROM x GROUP BY 1",
    ),
)
def structure_profile(spark, sf):
    p = ST.repo_profile(corpus(spark, sf))
    return p.select("repo_id", F.array_join("languages", ",").alias("languages"), "n_source_roots", "shape")


# manifests are placed in repositories by document id, so that lock and workspace rules fire
ROOT_NAMES = [n for n, _ in PACKAGE_MANAGERS] + ["package.json", "packages/a/package.json", "libs/b/pyproject.toml", "docs/index.md"]
MANIFEST_FILES = (
    f"mf AS (SELECT 'm' || (doc_id % 250) AS repo_id, ({S.sql_array(ROOT_NAMES)})[(doc_id // 50 + doc_id % 7) % {len(ROOT_NAMES)} + 1] AS path FROM documents)"
)


def manifest_files(spark, sf):
    docs = D.documents(spark, sf)
    n = F.col("doc_id")
    pick = F.element_at(F.array(*[F.lit(v) for v in ROOT_NAMES]), ((F.floor(n / 50) + n % 7) % len(ROOT_NAMES) + 1).cast("int"))
    return docs.select(F.concat(F.lit("m"), (n % 250).cast("string")).alias("repo_id"), pick.alias("path"), F.lit("{}").alias("text"), F.lit(2).cast("long").alias("size_bytes"))


@query(
    "package_managers",
    "WITH " + MANIFEST_FILES + " SELECT repo_id, array_to_string(list(m ORDER BY i), ',') AS managers FROM (SELECT DISTINCT repo_id, i, m FROM mf JOIN (VALUES "
    + ", ".join(f"({i}, '{n}', '{m}')" for i, (n, m) in enumerate(PACKAGE_MANAGERS))
    + ") t(i, n, m) ON mf.path = t.n) GROUP BY 1",
)
def package_managers(spark, sf):
    return ST.package_managers(manifest_files(spark, sf)).select("repo_id", F.array_join("managers", ",").alias("managers"))


@query(
    "structure_profile_findings",
    "WITH " + MANIFEST_FILES + """, f AS (SELECT repo_id, bool_or(regexp_matches(path, '\\.(?:py|pyi|ts|tsx|js|jsx|mjs|cjs)$')) AS app FROM mf GROUP BY 1)
 SELECT repo_id, '.' AS path, 'scan-blocker' AS category, 'medium' AS severity, 'high' AS confidence, 'This repository does not expose a real Python or JS/TS dependency graph target' AS title, 0 AS line,
 'No Python or JS/TS application surface was found outside ignored directories, so a dependency graph audit would be theater.' AS evidence FROM f WHERE NOT app""",
)
def structure_profile_findings(spark, sf):
    return shown(ST.profile_findings(ST.repo_profile(manifest_files(spark, sf))))


@query(
    "structure_declaration_gaps",
    "WITH " + MANIFEST_FILES + """, f AS (SELECT repo_id, bool_or(path = 'package.json') AS pkg, bool_or(path IN ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock')) AS lock,
  count(DISTINCT CASE WHEN path IN ('packages/a/package.json', 'libs/b/pyproject.toml') THEN path END) AS roots FROM mf GROUP BY 1)
 SELECT repo_id, 'dependency-declaration-gap' AS category FROM f WHERE pkg AND NOT lock UNION ALL SELECT repo_id, 'orphan-or-isolated-module' FROM f WHERE roots > 1 AND NOT pkg""",
)
def structure_declaration_gaps(spark, sf):
    files = manifest_files(spark, sf)
    app = files.select("repo_id").distinct().select("repo_id", F.lit("src/main.py").alias("path"), F.lit("").alias("text"), F.lit(0).cast("long").alias("size_bytes"))
    found = ST.profile_findings(ST.repo_profile(files.unionByName(app)))
    return found.select("repo_id", "category")


# ---- contract gates ---------------------------------------------------------------------------------------------


def words(col: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_text(w)})" for w in items) + ")"


_LOWNAME = f"lower({S.NAME})"
CG_CTES = [
    f"src AS (SELECT *, lower(text) AS low FROM files WHERE {surface_where('contracts')})",
    "fs AS (SELECT repo_id, "
    f"{words(_LOWNAME, CR.SURFACE_NAMES)} OR {words('low', CR.SURFACE_WORDS)} AS surface, {words(_LOWNAME, CR.SURFACE_NAMES)} OR {words('low', CR.SCHEMA_WORDS)} AS schema_source, "
    f"{words('low', CR.RUNTIME_WORDS)} AS runtime_schema, {words('low', CR.ERROR_WORDS)} AS error_contract, "
    f"list_contains(string_split(path, '/'), 'tests') AND {words('low', CR.TEST_WORDS)} AS contract_tests, "
    + " + ".join(f"(length(low) - length(replace(low, {sql_text(w)}, ''))) // {len(w)}" for w in CR.ESCAPES)
    + " AS escapes, regexp_matches(path, '\\.pyi?$') AS l_python, regexp_matches(path, '\\.tsx?$') AS l_typescript, regexp_matches(path, '\\.jsx?$') AS l_javascript FROM src)",
    "sg AS (SELECT repo_id, false AS python_strict, false AS typed_lint, false AS ts_strict, false AS architecture_config, bool_or(runtime_schema) AS runtime_schema, bool_or(error_contract) AS error_contract, "
    "bool_or(contract_tests) AS contract_tests, bool_or(l_python) AS l_python, bool_or(l_typescript) AS l_typescript, bool_or(l_javascript) AS l_javascript, count(*) FILTER (WHERE surface) AS n_surface, "
    "count(*) FILTER (WHERE schema_source) AS n_schema_sources, CAST(sum(escapes) AS BIGINT) AS escape_hatches FROM fs GROUP BY 1)",
    "gv AS (SELECT repo_id, count(*) FILTER (WHERE regexp_matches(path, '^\\.github/workflows/[^/]*\\.y[^/]*ml$')) AS n_workflows, false AS codeowners FROM files GROUP BY 1)",
    "sig AS (SELECT gv.repo_id, n_workflows, codeowners, sg.* EXCLUDE (repo_id) FROM gv LEFT JOIN sg USING (repo_id))",
    "st AS (" + " UNION ALL ".join(f"SELECT repo_id, '{g}' AS gate, {e} AS state FROM sig" for g, e in CR.STATES.items()) + ")",
    "lv(gate, state, severity, confidence) AS (VALUES " + ", ".join(f"('{g}', '{s}', '{v[0]}', '{v[1]}')" for (g, s), v in CR.LEVELS.items()) + ")",
]
CG_SIGNALS = ["n_surface", "n_schema_sources", "n_workflows", "escape_hatches", "runtime_schema", "error_contract", "contract_tests", "l_python", "l_typescript", "l_javascript"]


@query("contract_signals", with_files(*CG_CTES[:5], select=f"SELECT repo_id, {', '.join(CG_SIGNALS)} FROM sig"))
def contract_signals(spark, sf):
    return CG.repo_signals(corpus(spark, sf)).select("repo_id", *CG_SIGNALS)


@query("contract_gate_states", with_files(*CG_CTES, select="SELECT repo_id, gate, state, severity, confidence FROM st JOIN lv USING (gate, state)"))
def contract_gate_states(spark, sf):
    return CG.gate_states(CG.repo_signals(corpus(spark, sf)))


_CG_FOUND = (
    *CG_CTES,
    "tt(gate, title) AS (VALUES " + ", ".join(f"('{g}', {sql_text(t)})" for g, t in CR.TITLES.items()) + ")",
    "rk AS (SELECT repo_id, gate, state, severity, confidence, title, row_number() OVER (PARTITION BY repo_id ORDER BY CASE state WHEN 'missing' THEN 0 WHEN 'theater' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END, gate) AS rank FROM st JOIN lv USING (gate, state) JOIN tt USING (gate) WHERE state NOT IN ('enforced', 'hardened'))",
)
_CG_ROWS = """SELECT repo_id, gate AS category, severity, confidence, title, CAST(rank AS INTEGER) AS rank, state AS evidence,
 CASE WHEN gate IN ('architecture-boundaries', 'compile-time-gates') AND state = 'theater' THEN 'replace' WHEN state IN ('partial', 'unverified') THEN 'harden' ELSE 'adopt' END AS decision,
 CASE WHEN state = 'unverified' THEN 'unverified' WHEN severity IN ('critical', 'high') THEN 'block-now' ELSE 'block-changed-files' END AS merge_gate,
 gate IN ('contract-surface', 'compile-time-gates') AND state = 'partial' AS autofix FROM rk"""


@query("contract_findings", with_files(*_CG_FOUND, select=_CG_ROWS))
def contract_findings(spark, sf):
    found = CG.detect(CG.gate_states(CG.repo_signals(corpus(spark, sf))))
    return found.select("repo_id", "category", "severity", "confidence", "title", "rank", F.array_join("evidence", " | ").alias("evidence"), "decision", "merge_gate", "autofix")


@query("contract_findings_report", with_files(*_CG_FOUND, select=f"{_CG_ROWS} WHERE rank <= 6"))
def contract_findings_report(spark, sf):
    """The first six findings of each repository."""
    return contract_findings(spark, sf).where("rank <= 6")


_WIDE = ", ".join(f"max(state) FILTER (WHERE gate = '{g}') AS {g.replace('-', '_')}" for g in CR.STATES)


@query("contract_verdict", with_files(*CG_CTES, f"w AS (SELECT repo_id, {_WIDE}, count(*) FILTER (WHERE state IN ('enforced', 'hardened')) AS n_strong FROM st GROUP BY 1)", select=f"SELECT repo_id, {CR.VERDICT} AS verdict FROM w"))
def contract_verdict(spark, sf):
    return CG.verdicts(CG.gate_states(CG.repo_signals(corpus(spark, sf))))


UP_SQL = RUNS + """SELECT repo_id, bool_or(tool = 'basedpyright' AND status IN ('passed', 'issues')) AS python_strict, bool_or(tool IN ('tach', 'dependency-cruiser') AND status IN ('passed', 'issues')) AS architecture_config,
 CAST(coalesce(sum(CASE WHEN tool = 'semgrep' THEN issue_count ELSE 0 END), 0) AS BIGINT) AS escape_hatches FROM merged GROUP BY 1"""


@query("contract_tool_upgrades", UP_SQL)
def contract_tool_upgrades(spark, sf):
    merged = T.merge_tool_runs(D.tool_runs(spark, sf))
    base = merged.select("repo_id").distinct().select(
        "repo_id", *[F.lit(False).alias(c) for c in ("python_strict", "ts_strict", "typed_lint", "architecture_config")], F.lit(0).cast("long").alias("escape_hatches")
    )
    return CG.with_tool_runs(base, merged).select("repo_id", "python_strict", "architecture_config", "escape_hatches")


# ---- durable agents ---------------------------------------------------------------------------------------------

_PY = "regexp_matches(path, '\\.py$')"
_CT = f"({_PY} OR {S.NAME} = 'pyproject.toml')"
_WF = f"{_PY} AND (contains(low, '@workflow.defn') OR contains(low, 'temporalio.workflow'))"
DA_CTES = [
    f"src AS (SELECT *, lower(text) AS low FROM files WHERE {surface_where('durable-agents')})",
    f"fs AS (SELECT repo_id, {_PY} AND {words('low', DR.WORKFLOW_WORDS)} AS ws, {_PY} AND {words('low', DR.AGENT_WORDS)} AS ag, "
    f"(starts_with({S.NAME}, 'README') OR starts_with({S.NAME}, 'AGENTS') OR list_contains(string_split(path, '/'), 'docs')) AND {words('low', DR.DOC_WORDS)} AS dc, "
    + ", ".join(f"{_PY} AND contains(low, '{w}') AS {k}" for k, w in DR.OFFICIAL.items())
    + f", CASE WHEN {_WF} THEN len(list_filter(string_split(text, chr(10)), lambda s: {rx('s', DR.HAZARDS)})) ELSE 0 END AS hz, CASE WHEN {_WF} THEN len(list_filter(string_split(text, chr(10)), lambda s: contains(s, 'agent(') AND NOT contains(lower(s), 'temporalagent('))) ELSE 0 END AS ra, "
    f"{_PY} AND {words('low', ['sandbox_unrestricted', 'sandboxed=false', 'unsandboxedworkflowrunner'])} AS es, {_PY} AND contains(low, 'temporalagent(') AND {words('low', ['openaimodel(', 'anthropicmodel(', 'model='])} AS rm, "
    f"{_PY} AND contains(low, 'replay') AS rp, {_PY} AND contains(low, 'time_skipping') AS tk, {_PY} AND {words('low', ['testmodel', 'functionmodel', 'agent.override', 'allow_model_requests'])} AS fm, "
    f"contains(low, 'asyncio.sleep') AND {words('low', ['always wrong', 'forbidden'])} AS wd, {_CT} AND contains(low, 'args_validator') AS av, {_CT} AND contains(low, 'modelretry') AS mr, {_CT} AND contains(low, 'deps=') AS dp, {_CT} AND contains(low, 'deps_type') AS dt FROM src)",
    "sg AS (SELECT repo_id, bool_or(ws) AND bool_or(ag) AS applicable, count(*) FILTER (WHERE dc) AS docs, bool_or(temporal_agent) AS temporal_agent, bool_or(plugin) AS plugin, bool_or(workflow_class) AS workflow_class, "
    "CAST(sum(hz) AS BIGINT) AS hazards, CAST(sum(ra) AS BIGINT) AS raw_agents, count(*) FILTER (WHERE es) AS escapes, count(*) FILTER (WHERE rm) AS raw_models, count(*) FILTER (WHERE rp) AS replay, count(*) FILTER (WHERE tk) AS time_skipping, "
    "count(*) FILTER (WHERE fm) AS fake_model, count(*) FILTER (WHERE wd) AS wrong_docs, bool_or(av) AND NOT bool_or(mr) AS no_retry, bool_or(dp) AND NOT bool_or(dt) AS no_deps_type FROM fs GROUP BY 1)",
    "gv AS (SELECT repo_id, bool_or(path LIKE '.github/workflows/%') AS governance FROM files GROUP BY 1)",
    "sig AS (SELECT gv.repo_id, governance, 0 AS tool_issues, sg.* EXCLUDE (repo_id) FROM gv LEFT JOIN sg USING (repo_id))",
    "st AS (" + " UNION ALL ".join(f"SELECT repo_id, applicable, wrong_docs, '{g}' AS gate, CASE WHEN applicable THEN {e} ELSE 'not-applicable' END AS state FROM sig" for g, e in DR.STATES.items()) + ")",
]
DA_SIGNALS = ["applicable", "docs", *DR.OFFICIAL, "hazards", "raw_agents", "escapes", "raw_models", "replay", "time_skipping", "fake_model", "wrong_docs", "no_retry", "no_deps_type", "governance"]


def durable_signals_of(spark, sf):
    files = corpus(spark, sf)
    return DA.repo_signals(files, python_facts(select_surface(files, "durable-agents")))


@query("durable_signals", with_files(*DA_CTES[:5], select=f"SELECT repo_id, {', '.join(DA_SIGNALS)} FROM sig"))
def durable_signals(spark, sf):
    return durable_signals_of(spark, sf).select("repo_id", *DA_SIGNALS)


@query("durable_gate_states", with_files(*DA_CTES, select="SELECT repo_id, gate, state FROM st"))
def durable_gate_states(spark, sf):
    return DA.gate_states(durable_signals_of(spark, sf)).select("repo_id", "gate", "state")


_DWIDE = ", ".join(f"max(state) FILTER (WHERE gate = '{g}') AS {g.replace('-', '_')}" for g in DR.STATES)


@query("durable_verdict", with_files(*DA_CTES, f"w AS (SELECT repo_id, bool_or(applicable) AS applicable, {_DWIDE}, count(*) FILTER (WHERE state IN ('unsafe', 'fragile', 'unverified')) AS n_weak FROM st GROUP BY 1)", select=f"SELECT repo_id, {DR.VERDICT} AS verdict FROM w"))
def durable_verdict(spark, sf):
    return DA.verdicts(DA.gate_states(durable_signals_of(spark, sf)))


_DA_FOUND = (
    *DA_CTES,
    "lv(gate, state, severity, confidence) AS (VALUES " + ", ".join(f"('{g}', '{s}', '{v[0]}', '{v[1]}')" for (g, s), v in DR.LEVELS.items()) + ")",
    "tt(gate, title) AS (VALUES " + ", ".join(f"('{g}', {sql_text(t)})" for g, t in DR.TITLES.items()) + ")",
    "x AS (SELECT repo_id, gate, state, CASE WHEN gate = 'doc-grounding' AND state = 'fragile' AND wrong_docs = 0 THEN 'low' ELSE severity END AS severity, CASE WHEN gate = 'doc-grounding' AND state = 'fragile' AND wrong_docs = 0 THEN 'low' ELSE confidence END AS confidence, title FROM st JOIN lv USING (gate, state) JOIN tt USING (gate) WHERE state NOT IN ('sound', 'hardened'))",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, gate) AS rank FROM x)",
)
_DA_ROWS = "SELECT repo_id, gate AS category, severity, confidence, title, CAST(rank AS INTEGER) AS rank FROM rk"


@query("durable_findings", with_files(*_DA_FOUND, select=_DA_ROWS))
def durable_findings(spark, sf):
    found = DA.detect(DA.gate_states(durable_signals_of(spark, sf)))
    return found.select("repo_id", "category", "severity", "confidence", "title", "rank")


@query("durable_findings_report", with_files(*_DA_FOUND, select=f"{_DA_ROWS} WHERE rank <= 8"))
def durable_findings_report(spark, sf):
    """The first eight findings of each repository."""
    return durable_findings(spark, sf).where("rank <= 8")


# ---- findings of tools in other audits --------------------------------------------------------------------------


@query(
    "side_effect_tool_findings",
    RUNS + """SELECT repo_id, CASE WHEN status = 'failed' THEN 'scan-blocker' WHEN tool = 'ast-grep' THEN 'dynamic-dispatch-signal' ELSE 'side-effect-pattern-signal' END AS category,
 CASE WHEN status = 'failed' THEN tool || ' did not complete cleanly' ELSE tool || ' reported additional distributed side-effect evidence' END AS title, array_to_string(list_concat([summary], details), ' | ') AS evidence
 FROM merged WHERE status IN ('failed', 'issues')""",
)
def side_effect_tool_findings(spark, sf):
    found = SE.tool_findings(T.merge_tool_runs(D.tool_runs(spark, sf)))
    return found.select("repo_id", "category", "title", F.array_join("evidence", " | ").alias("evidence"))


_TOOLROWS = ", ".join(f"('{t}', {i}, '{v[0]}', '{v[1]}', '{v[2]}', {sql_text(v[3])}, '{v[4]}', '{v[5]}')" for i, (t, v) in enumerate(DR.TOOL_FINDINGS.items()))


@query(
    "durable_tool_findings",
    RUNS + f"""SELECT repo_id, category, severity, confidence, title, decision, merge_gate, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY i) AS INTEGER) AS rank FROM merged JOIN (VALUES {_TOOLROWS}) t(tool, i, category, severity, confidence, title, decision, merge_gate) USING (tool) WHERE status = 'issues'""",
)
def durable_tool_findings(spark, sf):
    """Tool findings alone: all gates of the applicable repositories are sound here."""
    merged = T.merge_tool_runs(D.tool_runs(spark, sf))
    sound = merged.select("repo_id").distinct().select(
        "repo_id", F.lit(True).alias("applicable"), F.lit("tool-contracts").alias("gate"), F.lit("sound").alias("state"), F.lit("low").alias("severity"), F.lit("medium").alias("confidence")
    )
    return DA.detect(sound, merged).select("repo_id", "category", "severity", "confidence", "title", "decision", "merge_gate", "rank")


@query(
    "durable_docs_ready",
    "WITH e AS (SELECT source AS repo_id, (['Temporal SDK', 'pydantic-ai', 'other'])[doc_id % 3 + 1] AS subject, doc_id % 4 = 0 AS ok FROM documents) SELECT repo_id, bool_or(ok AND contains(lower(subject), 'temporal')) AND bool_or(ok AND contains(lower(subject), 'pydantic')) AS docs_ready FROM e GROUP BY 1",
)
def durable_docs_ready(spark, sf):
    n = F.col("doc_id")
    subject = F.element_at(F.array(F.lit("Temporal SDK"), F.lit("pydantic-ai"), F.lit("other")), (n % 3 + 1).cast("int"))
    rows = D.documents(spark, sf).select(F.col("source").alias("repo_id"), subject.alias("subject"), F.when(n % 4 == 0, "verified").otherwise("failed").alias("status"))
    return DA.docs_ready(rows)


@query(
    "manifest_managers",
    "WITH " + MANIFEST_FILES + " SELECT repo_id, string_agg(m, ',' ORDER BY i) AS managers FROM (SELECT repo_id, m, min(i) AS i FROM mf JOIN (VALUES "
    + ", ".join(f"({i}, '{n}', '{m}')" for i, (n, m) in enumerate(MANAGERS))
    + ") t(i, n, m) ON regexp_extract(path, '[^/]*$') = n GROUP BY 1, 2) GROUP BY 1",
)
def manifest_managers(spark, sf):
    return ST.manifest_managers(manifest_files(spark, sf), MANAGERS).select("repo_id", F.array_join("managers", ",").alias("managers"))
