"""Queries over code facts, module shape, silent failure and domain drift.

Python facts depend only on the snippet a file carries (its prose is commented out), so
their oracle is a hand-checked table per snippet, shifted by the file's prose lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.functions.text import line_array, nloc
from repoaudit.operators import facts as X
from repoaudit.operators.findings import severity_counts
from repoaudit.operators.windows import duplicate_stats, shingles
from repoaudit.plans import domain_drift as DD
from repoaudit.plans import durable_agents as DA
from repoaudit.plans import module_shape as MS
from repoaudit.plans import silent_failure as SF
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.base import FOUND_COLS, shown
from repoaudit.queries.derived import code_corpus, corpus, sql_text
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import rx, surface_where, with_files
from repoaudit.rules import module_shape as MR
from repoaudit.rules import surface as SU
from repoaudit.sources.corpus import select_surface

K = len(D.SNIPPETS)
# snippet, line inside it, values
IMPORTS = [
    (3, 2, "src.api"), (36, 1, "os"), (36, 2, "sqlalchemy"), (36, 3, "fastapi"), (36, 4, "contexts.billing.domain"),
    (37, 1, "pydantic"), (38, 1, "abc"), (58, 1, "openai"), (59, 1, "anthropic"), (59, 4, "langchain"),
    (61, 1, "temporalio"), (62, 1, "pydantic_ai"),
]
# snippet, line, name, end line, code lines, complexity, parameters
FUNCTIONS = [
    (0, 3, "old_api", 4, 2, 1, 0), (1, 2, "older", 3, 2, 1, 0), (10, 1, "place", 3, 3, 1, 1), (11, 1, "place2", 3, 3, 1, 1),
    (12, 1, "place3", 4, 4, 1, 1), (13, 2, "call", 3, 2, 1, 0), (14, 2, "call2", 3, 2, 1, 1), (15, 2, "on_message", 4, 3, 1, 2),
    (23, 2, "handle", 3, 2, 1, 1), (25, 1, "f", 5, 5, 3, 1), (26, 1, "f2", 5, 5, 3, 1), (28, 1, "k", 3, 3, 2, 1),
    (37, 5, "run", 6, 2, 1, 1), (38, 3, "load", 4, 2, 1, 1), (38, 5, "store", 6, 2, 1, 1), (41, 2, "one", 3, 2, 3, 4),
    (41, 4, "two", 6, 3, 2, 0), (42, 1, "test_placeholder", 2, 2, 1, 0), (43, 2, "test_skipped", 3, 2, 1, 0),
    (44, 1, "test_m", 5, 5, 1, 2), (45, 1, "test_err", 3, 3, 1, 0), (61, 5, "run", 7, 3, 1, 1), (62, 4, "t", 5, 2, 1, 2),
    (62, 7, "bad", 8, 2, 1, 1),
]
# snippet, line, category, severity, confidence, title, evidence, only outside boundary paths
SILENT = [
    (25, 4, "exception-swallow", "high", "high", "Broad except with pass swallows the failure", "except Exception:", 0),
    (26, 4, "silent-default", "high", "medium", "Broad except returns a default instead of surfacing the error", "except:", 0),
    (27, 4, "skip-on-error", "high", "high", "Broad except continues the loop after failure", "except Exception:", 0),
    (28, 1, "optionality-leak", "low", "low", "Nullable type appears in a non-boundary path", "def k(a: int | None) -> int:", 1),
    (28, 2, "truthiness-fallback", "medium", "low", "Truthiness fallback may overwrite legitimate falsy values", "v = a or 0", 0),
    (28, 3, "lint-escape-hatch", "medium", "high", "noqa suppresses linter feedback", "return v  # noqa", 0),
    (29, 1, "type-escape-hatch", "high", "high", "Type ignore suppresses checker feedback", "x = cast(int, y)  # type: ignore", 0),
    (29, 1, "type-escape-hatch", "medium", "high", "typing.cast bypasses checker scrutiny", "x = cast(int, y)  # type: ignore", 0),
    (29, 2, "silent-default", "medium", "low", "dict.get style fallback may soften a required key", "z = d.get('k', 1)", 0),
    (29, 3, "optionality-leak", "low", "low", "hasattr may be widening a contract into maybe-logic", "w = hasattr(a, 'b')", 0),
    (7, 1, "optionality-leak", "low", "low", "getattr fallback may hide a model contract break", "value = getattr(obj, 'field', None)", 0),
    (30, 1, "exception-swallow", "high", "high", "contextlib.suppress hides exceptions", "with contextlib.suppress(Exception):", 0),
    (30, 2, "async-exception-leak", "high", "high", "Fire-and-forget async task is launched without observation", "loop.create_task(job())", 0),
    (31, 3, "cause-chain-loss", "medium", "high", "New exception is raised in except without `from e`", "except ValueError as e:", 0),
]
# snippet, line, class, category, only in domain files
CLASS_FINDINGS = [
    (37, 4, "OrderQuery", "thin-wrapper", "medium", "high", 0), (38, 2, "Port", "abc-overuse", "medium", "high", 0),
    (37, 4, "OrderQuery", "anemic-domain-model-signal", "medium", "low", 1),
]
# snippet, line, module, category (domain files only)
IMPORT_FINDINGS = [
    (3, 2, "src.api", "domain-boundary-leak", "high", "high"),
    (36, 2, "sqlalchemy", "domain-boundary-leak", "high", "high"), (36, 3, "fastapi", "domain-boundary-leak", "high", "high"),
    (37, 1, "pydantic", "framework-coupling-signal", "medium", "medium"),
]
UNPARSED = [8, 21, 22, 24, 32, 33, 34, 35, 39, 40, 46, 47, 48, 49, 50, 51, 52, 53, 54, 57, 64, 65]


def values(rows) -> str:
    lit = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def with_code(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([D.code_files_cte(), *ctes]) + "\n" + select


def py_base(surface: str) -> str:
    return (
        f"py AS (SELECT repo_id, path, f.doc_id % {K} AS k, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS p "
        f"FROM files f JOIN documents d USING (doc_id) WHERE path LIKE '%.py' AND {surface_where(surface)})"
    )


def py_facts(spark, sf, surface):
    return X.python_facts(select_surface(code_corpus(spark, sf), surface))


@query("python_imports", with_code(py_base("module-shape"), select=f"SELECT repo_id, path, m AS module, CAST(p + n AS INTEGER) AS line FROM py JOIN {values(IMPORTS)} t(k, n, m) USING (k)"))
def python_imports(spark, sf):
    return X.rows_of(py_facts(spark, sf, "module-shape"), "imports").select("repo_id", "path", "module", "line")


@query("python_functions", with_code(py_base("module-shape"), select=f"SELECT repo_id, path, name, CAST(p + n AS INTEGER) AS line, CAST(p + e AS INTEGER) AS end_line, nloc, complexity, params FROM py JOIN {values(FUNCTIONS)} t(k, n, name, e, nloc, complexity, params) USING (k)"))
def python_functions(spark, sf):
    return X.rows_of(py_facts(spark, sf, "module-shape"), "functions").select("repo_id", "path", "name", "line", "end_line", "nloc", "complexity", "params")


@query("python_parse_errors", with_code(py_base("silent-failure"), select=f"SELECT repo_id, path FROM py WHERE k IN ({', '.join(map(str, UNPARSED))})"))
def python_parse_errors(spark, sf):
    return SF.scan_blockers(py_facts(spark, sf, "silent-failure")).select("repo_id", "path")


PY_SILENT = (
    f"SELECT repo_id, path, category, severity, confidence, title, CAST(p + n AS INTEGER) AS line, evidence FROM py JOIN {values(SILENT)} "
    f"t(k, n, category, severity, confidence, title, evidence, inner_only) USING (k) WHERE inner_only = 0 OR NOT {rx('path', SU.BOUNDARY_PATH)}"
)


@query("silent_failure_python", with_code(py_base("silent-failure"), select=PY_SILENT))
def silent_failure_python(spark, sf):
    return shown(SF.detect_python(py_facts(spark, sf, "silent-failure")))


# JavaScript: pieces, blanked code and rules stated in the other engine
JS_PIECES_SQL = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"(?:[^"\\]|\\.)*(?:"|\\?\z)|'(?:[^'\\]|\\.)*(?:'|\\?\z)|`(?:[^`\\]|\\.)*(?:`|\\?\z)|[^/"'`]+|/"""


def js_rule_arm(rule) -> str:
    pattern, category, severity, confidence, title, _ = rule
    marked = f"regexp_replace(code, {sql_text('(' + pattern + ')')}, chr(1) || '\\1', 'g')"
    return (
        f"SELECT repo_id, path, '{category}' AS category, '{severity}' AS severity, '{confidence}' AS confidence, {sql_text(title)} AS title, n AS line, raw FROM "
        f"(SELECT repo_id, path, lines, unnest(ls) AS l, generate_subscripts(ls, 1) AS n, lines[generate_subscripts(ls, 1)] AS raw FROM (SELECT *, string_split({marked}, chr(10)) AS ls FROM js)) WHERE contains(l, chr(1))"
    )


JS_CTES = [
    f"jp AS (SELECT repo_id, path, text, regexp_extract_all(text, {sql_text(JS_PIECES_SQL)}) AS ps FROM files WHERE {surface_where('silent-failure')} AND NOT path LIKE '%.py')",
    "js AS (SELECT repo_id, path, string_split(text, chr(10)) AS lines, ps, array_to_string(list_transform(ps, lambda x: CASE WHEN regexp_matches(x, '^(?://|/\\*|[\"''`])') THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '') AS code FROM jp)",
    "cl AS (SELECT repo_id, path, lines, unnest(ls) AS l, generate_subscripts(ls, 1) AS n, lines[generate_subscripts(ls, 1)] AS raw FROM (SELECT *, string_split(code, chr(10)) AS ls FROM js))",
    "cm AS (SELECT repo_id, path, lines, ps, unnest(ps) AS c, generate_subscripts(ps, 1) AS i FROM js)",
    "cn AS (SELECT repo_id, path, c, n, lines[n] AS raw FROM (SELECT repo_id, path, lines, c, CAST(1 + coalesce(sum(length(c) - length(replace(c, chr(10), ''))) OVER (PARTITION BY repo_id, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM cm) WHERE regexp_matches(c, '^(?://|/\\*)'))",
    "ch AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY n) AS rn FROM cl WHERE (length(l) - length(replace(l, '?.', ''))) // 2 >= 2)",
    f"df AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY n, kind) AS rn FROM (SELECT *, 1 AS kind FROM cl WHERE contains(l, '||') AND {rx('l', SF.TRUTHY_DEFAULT)} UNION ALL SELECT *, 2 FROM cl WHERE contains(l, '??') AND {rx('l', SF.NULLISH_DEFAULT)}))",
    # no look-behind in this engine: the character before the name is matched instead
    r"nn AS (SELECT * FROM cl WHERE regexp_matches(l, '(?:^|[^=!\w$])[A-Za-z_$][\w$.\])]*!\s*(?:[.\[);,:?]|$)') AND NOT contains(raw, '!='))",
    "jf AS ("
    + " UNION ".join(js_rule_arm(r) for r in SF.JS_RULES)
    + " UNION SELECT repo_id, path, 'type-escape-hatch', 'high', 'high', 'ts-comment suppression hides a type problem', n, raw FROM cn WHERE regexp_matches(c, '@ts-(?:ignore|expect-error|nocheck)\\b')"
    + " UNION SELECT repo_id, path, 'lint-escape-hatch', 'medium', 'high', 'eslint-disable suppresses rule feedback', n, raw FROM cn WHERE contains(c, 'eslint-disable')"
    + " UNION SELECT repo_id, path, 'type-escape-hatch', 'medium', 'medium', 'Non-null assertion removes a nullish safety check at compile time', n, raw FROM nn"
    + " UNION SELECT repo_id, path, 'optionality-leak', 'low', 'low', 'Optional chaining is stacked on a core access path', n, raw FROM ch"
    + " UNION SELECT repo_id, path, CASE kind WHEN 1 THEN 'truthiness-fallback' ELSE 'silent-default' END, CASE kind WHEN 1 THEN 'medium' ELSE 'low' END, 'low', CASE kind WHEN 1 THEN '`||` fallback may overwrite legitimate falsy values' ELSE 'Nullish fallback may be softening a required contract' END, n, raw FROM df)",
]
JS_SELECT = f"SELECT repo_id, path, category, severity, confidence, title, CAST(line AS INTEGER) AS line, {S.strip('raw')} AS evidence FROM jf"


@query("silent_failure_js", with_code(*JS_CTES, select=JS_SELECT))
def silent_failure_js(spark, sf):
    return shown(SF.detect_js(select_surface(code_corpus(spark, sf), "silent-failure")))


@query(
    "silent_failure_verdict",
    with_code(
        py_base("silent-failure"), *JS_CTES, f"af AS ({PY_SILENT} UNION ALL {JS_SELECT})",
        select=f"""SELECT r.repo_id, {S.severity_sql('af')}, CASE WHEN count(*) FILTER (WHERE severity = 'critical' OR category IN ('exception-swallow', 'skip-on-error', 'async-exception-leak')) > 0 THEN 'silent-failure-risk'
 WHEN count(*) FILTER (WHERE category IN ('type-escape-hatch', 'lint-escape-hatch', 'silent-default', 'truthiness-fallback', 'optionality-leak', 'unsafe-optional-chain')) > 0 THEN 'contract-softened' ELSE 'fail-loud' END AS verdict
 FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN af USING (repo_id) GROUP BY 1""",
    ),
)
def silent_failure_verdict(spark, sf):
    return SF.audit(code_corpus(spark, sf))[1].select("repo_id", "critical", "high", "medium", "low", "verdict")


# ---- domain drift -----------------------------------------------------------------------------------------------

DOMAIN = "list_has_any(string_split(lower(path), '/'), ['domain', 'domains'])"
DD_FOUND = (
    f"SELECT repo_id, path, category, severity, confidence, CAST(p + n AS INTEGER) AS line, module AS evidence FROM py JOIN {values(IMPORT_FINDINGS)} t(k, n, module, category, severity, confidence) USING (k) WHERE {DOMAIN}"
    f" UNION ALL SELECT repo_id, path, 'cross-context-model-bleed', 'high', 'high', CAST(p + 4 AS INTEGER), 'contexts.billing.domain' FROM py WHERE k = 36 AND path LIKE 'contexts/orders/domain/%'"
    f" UNION ALL SELECT repo_id, path, category, severity, confidence, CAST(p + n AS INTEGER), name FROM py JOIN {values(CLASS_FINDINGS)} t(k, n, name, category, severity, confidence, inner_only) USING (k) WHERE inner_only = 0 OR {DOMAIN}"
)


@query("domain_drift_findings", with_code(py_base("pythonic-ddd-drift"), select=DD_FOUND))
def domain_drift_findings(spark, sf):
    found = DD.detect_files(py_facts(spark, sf, "pythonic-ddd-drift"))
    return shown(found).drop("title")


DD_COUNTS = (
    f"dc AS (SELECT repo_id, count(*) AS python_files, count(*) FILTER (WHERE {DOMAIN}) AS domain_files, 0 AS entrypoints, CAST(coalesce(sum(CASE WHEN k = 37 THEN 2 ELSE 0 END), 0) AS BIGINT) AS cqrs_names, 0 AS read_models FROM py GROUP BY 1)"
)
DD_REPO = (
    "SELECT repo_id, '.' AS path, 'cqrs-ceremony-signal' AS category, 'medium' AS severity, 'low' AS confidence, 1 AS line, 'command/query/handler class count: ' || cqrs_names || ' | read-model clue count: 0' AS evidence FROM dc WHERE cqrs_names >= 6"
    " UNION ALL SELECT repo_id, '.', 'composition-root-gap', 'low', 'low', 1, 'No main.py / app.py / bootstrap.py / container.py clue found' FROM dc WHERE python_files > 0"
)


@query("domain_drift_counts", with_code(py_base("pythonic-ddd-drift"), DD_COUNTS, select="SELECT * FROM dc"))
def domain_drift_counts(spark, sf):
    files = code_corpus(spark, sf)
    return DD.repo_counts(files, X.python_facts(select_surface(files, "pythonic-ddd-drift"))).select(
        "repo_id", "python_files", "domain_files", F.col("entrypoints").cast("int").alias("entrypoints"), "cqrs_names", F.col("read_models").cast("int").alias("read_models")
    )


@query(
    "domain_drift_verdict",
    with_code(
        py_base("pythonic-ddd-drift"), DD_COUNTS, f"af AS ({DD_FOUND} UNION ALL {DD_REPO})",
        select="""SELECT dc.repo_id, CASE WHEN count(*) FILTER (WHERE category IN ('domain-boundary-leak', 'cross-context-model-bleed')) > 0 THEN 'drifting'
 WHEN count(*) FILTER (WHERE severity = 'medium') >= 3 OR count(*) FILTER (WHERE category = 'thin-wrapper') >= 2 OR count(*) FILTER (WHERE category = 'abc-overuse') >= 2 THEN 'ceremonial'
 WHEN count(category) > 0 THEN 'contained' ELSE 'disciplined' END AS verdict FROM dc LEFT JOIN af USING (repo_id) GROUP BY 1""",
    ),
)
def domain_drift_verdict(spark, sf):
    files = code_corpus(spark, sf)
    facts = X.python_facts(select_surface(files, "pythonic-ddd-drift"))
    return DD.audit(files, facts)[1].select("repo_id", "verdict")


DRIFT_TOOLS = "WITH " + D.tool_runs_cte() + ", " + D.merged_runs_cte() + """ SELECT repo_id, CASE tool WHEN 'tach' THEN 'boundary-tool-signal' WHEN 'ruff' THEN 'lint-drift' ELSE 'type-contract-drift' END AS category,
 CASE WHEN tool = 'tach' AND status = 'issues' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN len(details) > 0 THEN array_to_string(details, ' | ') ELSE summary END AS evidence
 FROM merged WHERE (tool = 'tach' AND status IN ('issues', 'failed')) OR (tool IN ('ruff', 'basedpyright') AND status = 'issues')"""


@query("domain_drift_tool_findings", DRIFT_TOOLS)
def domain_drift_tool_findings(spark, sf):
    from repoaudit.operators.tool_runs import merge_tool_runs

    found = DD.tool_findings(merge_tool_runs(D.tool_runs(spark, sf)))
    return found.select("repo_id", "category", "severity", F.array_join("evidence", " | ").alias("evidence"))


@query(
    "durable_tool_contracts",
    with_code(py_base("durable-agents"), select="SELECT repo_id, path, CAST(p + 7 AS INTEGER) AS line, '@agent.tool first parameter is not annotated as RunContext' AS message FROM py WHERE k = 62"),
)
def durable_tool_contracts(spark, sf):
    return DA.tool_issues(py_facts(spark, sf, "durable-agents"))


# ---- module shape -----------------------------------------------------------------------------------------------

TS_CLEAN = r"""array_to_string(list_transform(regexp_extract_all(text, '(?s)//[^\n\r]*|/\*.*?(?:\*/|\z)|[^/]+|/'), lambda p: CASE WHEN starts_with(p, '//') THEN '' WHEN starts_with(p, '/*') THEN regexp_replace(p, '[^\n\r]', '', 'g') ELSE p END), '')"""
NORM_CTES = [
    f"ms AS (SELECT repo_id, path, path LIKE '%.py' AS py, text, CASE WHEN path LIKE '%.py' THEN list_filter(list_transform(string_split(text, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> '' AND NOT starts_with(s, '#')) "
    f"ELSE list_filter(list_transform(string_split({TS_CLEAN}, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> '') END AS code FROM files WHERE {surface_where('module-shape')})",
    "nm AS (SELECT repo_id, path, list_transform(code, lambda s: regexp_replace(s, '\\s+', '', 'g')) AS norm FROM ms)",
    "sh AS (SELECT repo_id, path, i AS start, array_to_string(norm[i:i + 7], '||') AS body FROM (SELECT *, unnest(range(1, len(norm) - 6)) AS i FROM nm))",
    "sd AS (SELECT repo_id, path, CAST(start AS INTEGER) AS start, sha1(body) AS digest FROM sh WHERE length(body) - 14 >= 60)",
]


@query("code_line_counts", with_files(NORM_CTES[0], select="SELECT repo_id, path, CAST(len(code) AS INTEGER) AS code_lines, CAST(len(string_split(text, chr(10))) AS INTEGER) AS total_lines FROM ms"))
def code_line_counts(spark, sf):
    src = select_surface(corpus(spark, sf), "module-shape")
    lang = MS.language(F.col("path"))
    return src.select("repo_id", "path", nloc(F.col("text"), lang).alias("code_lines"), F.size(line_array(F.col("text"))).alias("total_lines"))


@query("line_shingles", with_files(*NORM_CTES, select="SELECT * FROM sd"))
def line_shingles(spark, sf):
    src = select_surface(corpus(spark, sf), "module-shape")
    return shingles(src, MS.language(F.col("path")))


@query(
    "duplicate_files",
    with_files(
        *NORM_CTES,
        "rp AS (SELECT repo_id, digest FROM sd GROUP BY 1, 2 HAVING count(*) >= 2)",
        "mm AS (SELECT sd.* FROM sd JOIN rp USING (repo_id, digest))",
        "own AS (SELECT repo_id, path, CAST(count(DISTINCT start) AS INTEGER) AS duplicate_windows FROM mm GROUP BY 1, 2)",
        "pt AS (SELECT a.repo_id, a.path, CAST(count(DISTINCT b.path) FILTER (WHERE b.path <> a.path) AS INTEGER) AS duplicate_partners FROM mm a JOIN mm b ON a.repo_id = b.repo_id AND a.digest = b.digest GROUP BY 1, 2)",
        select="SELECT * FROM own JOIN pt USING (repo_id, path)",
    ),
)
def duplicate_files(spark, sf):
    src = select_surface(corpus(spark, sf), "module-shape")
    return duplicate_stats(shingles(src, MS.language(F.col("path"))))


DOC_SHINGLES = [
    "nd AS (SELECT lang AS repo_id, 'doc_' || doc_id || '.py' AS path, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: " + S.strip("s") + "), lambda s: s <> '' AND NOT starts_with(s, '#')), lambda s: regexp_replace(s, '\\s+', '', 'g')) AS norm FROM documents)",
    "dd AS (SELECT repo_id, path, i AS start, sha1(array_to_string(norm[i:i + 7], '||')) AS digest, length(array_to_string(norm[i:i + 7], '')) AS n FROM (SELECT *, unnest(range(1, len(norm) - 6)) AS i FROM nd))",
    "sd AS (SELECT * FROM dd WHERE n >= 60)",
    "mm AS (SELECT sd.* FROM sd JOIN (SELECT repo_id, digest FROM sd GROUP BY 1, 2 HAVING count(*) >= 2) USING (repo_id, digest))",
    "own AS (SELECT repo_id, path, CAST(count(DISTINCT start) AS INTEGER) AS duplicate_windows FROM mm GROUP BY 1, 2)",
    "pt AS (SELECT a.repo_id, a.path, CAST(count(DISTINCT b.path) FILTER (WHERE b.path <> a.path) AS INTEGER) AS duplicate_partners FROM mm a JOIN mm b ON a.repo_id = b.repo_id AND a.digest = b.digest GROUP BY 1, 2)",
]


@query("duplicate_documents", "WITH " + ",\n".join(DOC_SHINGLES) + " SELECT * FROM own JOIN pt USING (repo_id, path)")
def duplicate_documents(spark, sf):
    """A few very large repositories: one per language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    files = docs.select(F.col("lang").alias("repo_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    return duplicate_stats(shingles(files, F.lit("python")))


TS_IMPORTS_SQL = (
    r"list_filter(list_concat(regexp_extract_all(text, '(?m)^\s*import\s+.*?\s+from\s+[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(text, '(?m)^\s*export\s+.*?\s+from\s+[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(text, 'require\(\s*[\"'']([^\"'']+)[\"'']\s*\)', 1)), lambda m: m <> '')"
).replace('\\"', '"')
TS_EXPORTS_SQL = (
    f"len(regexp_extract_all(text, {sql_text(X.TS_EXPORT)})) + len(list_filter(flatten(list_transform(regexp_extract_all(text, {sql_text(X.TS_EXPORT_LIST)}, 1), lambda s: string_split(s, ','))), lambda n: {S.strip('n')} <> ''))"
)


@query("typescript_imports", with_files(select=f"SELECT repo_id, path, unnest({TS_IMPORTS_SQL}) AS module FROM files WHERE regexp_matches(path, '\\.tsx?$')"))
def typescript_imports(spark, sf):
    ts = corpus(spark, sf).where(F.col("path").rlike(r"\.tsx?$"))
    return ts.select("repo_id", "path", F.explode(X.ts_imports(F.col("text"))).alias("module"))


@query("typescript_exports", with_files(select=f"SELECT repo_id, path, CAST({TS_EXPORTS_SQL} AS INTEGER) AS exports FROM files WHERE regexp_matches(path, '\\.tsx?$')"))
def typescript_exports(spark, sf):
    ts = corpus(spark, sf).where(F.col("path").rlike(r"\.tsx?$"))
    return ts.select("repo_id", "path", X.ts_export_count(F.col("text")).alias("exports"))


# snippet, line, name, end, code lines, complexity, parameters: functions found in the TypeScript files
TS_FUNCTIONS = [
    (39, 2, "A", 5, 4, 3, 0), (40, 1, "load", 6, 4, 3, 2),
]


@query(
    "typescript_functions",
    with_code(
        f"ts AS (SELECT repo_id, path, f.doc_id % {K} AS k, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS p FROM files f JOIN documents d USING (doc_id) WHERE path LIKE '%.ts')",
        select=f"SELECT repo_id, path, name, CAST(p + n AS INTEGER) AS line, CAST(p + e AS INTEGER) AS end_line, nloc, complexity, params FROM ts JOIN {values(TS_FUNCTIONS)} t(k, n, name, e, nloc, complexity, params) USING (k)",
    ),
)
def typescript_functions(spark, sf):
    return X.ts_function_rows(code_corpus(spark, sf))


def _level(expr: str, limits) -> str:
    if len(limits) == 3:
        return f"CASE WHEN {expr} >= {limits[2]} THEN 'critical' WHEN {expr} >= {limits[1]} THEN 'high' WHEN {expr} >= {limits[0]} THEN 'medium' END"
    return f"CASE WHEN {expr} >= {limits[1]} THEN 'high' WHEN {expr} >= {limits[0]} THEN 'medium' END"


def _demote(expr: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN CASE {expr} WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'low' END ELSE {expr} END"


_MIXED = "CASE WHEN nt >= 4 AND code_lines >= 200 THEN CASE WHEN code_lines >= 900 THEN 'high' ELSE 'medium' END WHEN nt >= 3 AND code_lines >= 180 THEN 'medium' WHEN nt >= 2 AND fan_out >= 12 AND code_lines >= 250 THEN 'medium' END"
MS_CTES = [
    D.part_metrics_cte(),
    "sg AS (SELECT *, NOT generated_like AND NOT migration_like AS live, "
    f"{_demote(_level('code_lines', MR.FILE_NLOC), 'test_like')} AS s1, {_demote(_level('fan_out', MR.FAN_OUT), 'test_like')} AS s2, "
    f"{_demote('CASE WHEN NOT small_barrel THEN ' + _level('exports', MR.EXPORTS) + ' END', 'test_like')} AS s3, {_demote(_MIXED, 'test_like')} AS s4, "
    f"{_demote(_level('dup', MR.DUPLICATE_WINDOWS), 'test_like')} AS s5, {_level('greatest(fn, fc)', MR.FUNCTION_NLOC)} AS s6 FROM pm)",
    "cs AS (SELECT *, (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT + (s6 IS NOT NULL)::INT AS comp FROM sg)",
    "gd AS (SELECT *, comp >= 3 AND code_lines >= 500 AS god, code_lines >= 1800 OR comp >= 4 AS extreme FROM cs)",
    f"""found AS (SELECT repo_id, path, 'scan-blocker' AS category, 'low' AS severity, 'high' AS confidence, {sql_text(MR.TITLES['scan-blocker'])} AS title, 1 AS line, 'python parse error: invalid syntax (line 3)' AS evidence, 'unverified' AS merge_gate FROM gd WHERE broken
 UNION ALL SELECT repo_id, path, 'god-module', CASE WHEN extreme THEN 'critical' ELSE 'high' END, 'high', {sql_text(MR.TITLES['god-module'])}, 1, code_lines || ' code lines, fan-out ' || fan_out || ', exports ' || exports || ', responsibilities ' || CASE WHEN nt = 0 THEN 'n/a' ELSE array_to_string(tags, ', ') END || ', duplicate windows ' || dup || ', max function ' || fn || ' lines.', CASE WHEN extreme THEN 'block-now' ELSE 'block-changed-files' END FROM gd WHERE live AND god
 UNION ALL SELECT repo_id, path, 'oversized-file', s1, 'high', {sql_text(MR.TITLES['oversized-file'])}, 1, code_lines || ' code lines in one file.', CASE WHEN code_lines >= 1800 OR s1 = 'critical' THEN 'block-now' WHEN s1 = 'high' THEN 'block-changed-files' ELSE 'warn-only' END FROM gd WHERE live AND NOT god AND s1 IS NOT NULL
 UNION ALL SELECT repo_id, path, 'hub-module', s2, 'high', {sql_text(MR.TITLES['hub-module'])}, 1, 'Imports ' || fan_out || ' unique modules.', CASE WHEN fan_out >= 25 OR s2 = 'critical' THEN 'block-now' WHEN s2 = 'high' THEN 'block-changed-files' ELSE 'warn-only' END FROM gd WHERE live AND NOT god AND s2 IS NOT NULL
 UNION ALL SELECT repo_id, path, 'export-surface-sprawl', s3, 'high', {sql_text(MR.TITLES['export-surface-sprawl'])}, 1, 'Exports ' || exports || ' public symbols.', CASE WHEN exports >= 40 OR s3 = 'critical' THEN 'block-now' WHEN s3 = 'high' THEN 'block-changed-files' ELSE 'warn-only' END FROM gd WHERE live AND NOT god AND s3 IS NOT NULL
 UNION ALL SELECT repo_id, path, 'mixed-responsibility', s4, 'medium', {sql_text(MR.TITLES['mixed-responsibility'])}, 1, 'Responsibility tags: ' || array_to_string(tags, ', ') || '.', CASE WHEN s4 = 'high' THEN 'block-changed-files' ELSE 'warn-only' END FROM gd WHERE live AND NOT god AND s4 IS NOT NULL
 UNION ALL SELECT repo_id, path, 'duplication-cluster', s5, 'medium', {sql_text(MR.TITLES['duplication-cluster'])}, 1, dup || ' duplicate windows across ' || partners || ' partner files.', CASE WHEN s5 = 'high' THEN 'block-changed-files' ELSE 'warn-only' END FROM gd WHERE live AND NOT god AND s5 IS NOT NULL)""",
]


@query("module_shape_findings", "WITH " + ",\n".join(MS_CTES) + f" SELECT {FOUND_COLS}, merge_gate FROM found")
def module_shape_findings(spark, sf):
    return shown(MS.detect_files(D.part_metrics(spark, sf)), "merge_gate")


@query("module_shape_finding_ids", "WITH " + ",\n".join(MS_CTES) + " SELECT path, category, 'msh-' || substr(sha1(CASE category WHEN 'export-surface-sprawl' THEN 'export-surface' ELSE category END || ':' || path || ':'), 1, 8) AS id FROM found")
def module_shape_finding_ids(spark, sf):
    return MS.with_ids(MS.detect_files(D.part_metrics(spark, sf))).select("path", "category", "id")


@query(
    "module_shape_verdict",
    "WITH " + ",\n".join(MS_CTES) + """, fl AS (SELECT repo_id, count(*) FILTER (WHERE live) AS meaningful, count(*) FILTER (WHERE live AND broken) AS blocked FROM gd GROUP BY 1),
 sv AS (SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m FROM found WHERE category <> 'scan-blocker' GROUP BY 1)
 SELECT repo_id, meaningful, CASE WHEN meaningful = 0 THEN 'not-applicable' WHEN blocked > 0 THEN 'scan-blocked' WHEN c > 0 THEN 'split-before-merge' WHEN h >= 2 THEN 'sprawling' WHEN h >= 1 OR m >= 3 THEN 'contained' ELSE 'disciplined' END AS verdict FROM fl LEFT JOIN sv USING (repo_id)""",
)
def module_shape_verdict(spark, sf):
    m = D.part_metrics(spark, sf)
    return MS.verdict_rows(m, MS.detect_files(m), m).select("repo_id", "meaningful", "verdict")


_FL = "CASE WHEN nloc >= 200 OR complexity >= 40 THEN 'critical' WHEN nloc >= 120 OR complexity >= 25 THEN 'high' WHEN nloc >= 80 OR complexity >= 15 THEN 'medium' END"
FN_CTES = [
    D.item_functions_cte(),
    f"lf AS (SELECT *, {_FL} AS raw FROM fns)",
    f"ff AS (SELECT repo_id, path, name, nloc, complexity, line, raw, {_demote('raw', 'path LIKE ' + chr(39) + 'tests/%' + chr(39))} AS severity, nloc || ' code lines, approx complexity ' || complexity || ', ' || params || ' parameters.' AS evidence FROM lf WHERE raw IS NOT NULL)",
]


@query("long_functions", "WITH " + ",\n".join(FN_CTES) + " SELECT repo_id, path, name, line, severity, evidence FROM ff")
def long_functions(spark, sf):
    found = MS.detect_functions(D.item_functions(spark, sf))
    return found.select("repo_id", "path", F.regexp_extract("title", "'(.*)'", 1).alias("name"), "line", "severity", F.array_join("evidence", " | ").alias("evidence"))


@query(
    "long_functions_report",
    "WITH " + ",\n".join(FN_CTES) + " SELECT repo_id, path, line, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE raw WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, nloc DESC, complexity DESC, path, line) AS rn FROM ff) WHERE rn <= 12",
)
def long_functions_report(spark, sf):
    found = MS.longest_functions(D.item_functions(spark, sf))
    return found.select("repo_id", "path", "line", "severity")


@query("module_shape_audit")
def module_shape_audit(spark, sf):
    """Whole chain on parsed sources; per-step oracles are the queries above."""
    _, found, verdicts = MS.audit(code_corpus(spark, sf))
    return severity_counts(found, verdicts).join(verdicts.select("repo_id", "verdict"), "repo_id")




# snippet, line, bare, broad, passes, continues, returns a default, loses the cause
HANDLERS = [
    (25, 4, "false", "true", "true", "false", "false", "false"), (26, 4, "true", "true", "false", "false", "true", "false"),
    (27, 4, "false", "true", "false", "true", "false", "false"), (31, 3, "false", "false", "false", "false", "false", "true"),
]
# snippet, line, name, shell, thin, public methods, non-trivial methods
CLASSES = [
    (15, 1, "OrderConsumer", "false", "false", 1, 1), (37, 2, "OrderCommand", "false", "false", 0, 0), (37, 4, "OrderQuery", "false", "true", 1, 0),
    (38, 2, "Port", "true", "false", 2, 2), (61, 3, "W", "false", "false", 1, 1),
]
# snippet, line, call, positional arguments, result dropped
CALLS = [
    (7, 1, "getattr", 3, "false"), (29, 1, "cast", 2, "false"), (29, 2, "d.get", 2, "false"), (29, 3, "hasattr", 2, "false"),
    (30, 1, "contextlib.suppress", 1, "false"), (30, 2, "loop.create_task", 1, "true"),
]


@query("python_handlers", with_code(py_base("silent-failure"), select=f"SELECT repo_id, path, CAST(p + n AS INTEGER) AS line, bare = 'true' AS bare, broad = 'true' AS broad, passes = 'true' AS passes, continues = 'true' AS continues, rd = 'true' AS returns_default, lc = 'true' AS loses_cause FROM py JOIN {values(HANDLERS)} t(k, n, bare, broad, passes, continues, rd, lc) USING (k)"))
def python_handlers(spark, sf):
    return X.rows_of(py_facts(spark, sf, "silent-failure"), "handlers").drop("src")


@query("python_classes", with_code(py_base("pythonic-ddd-drift"), select=f"SELECT repo_id, path, name, CAST(p + n AS INTEGER) AS line, shell = 'true' AS shell, thin = 'true' AS thin, public, nontrivial FROM py JOIN {values(CLASSES)} t(k, n, name, shell, thin, public, nontrivial) USING (k)"))
def python_classes(spark, sf):
    return X.rows_of(py_facts(spark, sf, "pythonic-ddd-drift"), "classes")


@query("python_calls", with_code(py_base("silent-failure"), select=f"SELECT repo_id, path, name, CAST(p + n AS INTEGER) AS line, args, dropped = 'true' AS dropped FROM py JOIN {values(CALLS)} t(k, n, name, args, dropped) USING (k)"))
def python_calls(spark, sf):
    return X.rows_of(py_facts(spark, sf, "silent-failure"), "calls").select("repo_id", "path", "name", "line", "args", "dropped")
