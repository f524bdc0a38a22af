"""Queries over API surfaces, document validation, and run state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repoaudit.operators.manifests import manifest_deps
from repoaudit.plans import api_surfaces as A
from repoaudit.plans import validation as V
from repoaudit.plans.cleanup import detect_files
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.base import AS_OF, CLEAN_CTE, FOUND_COLS, shown
from repoaudit.queries.derived import corpus, sql_text
from repoaudit.queries.health import WITH as RUNS_WITH
from repoaudit.queries.health import runs_of
from repoaudit.queries.registry import ORACLES, query
from repoaudit.queries.sqlgen import rx, surface_where, with_files
from repoaudit.rules import api_surfaces as R
from repoaudit.rules import catalog as C
from repoaudit.session import checkpoint_root, stage, stage_path
from repoaudit.sources.tables import read_aliases, read_rules
from repoaudit.streaming import run_state as X
from repoaudit.streaming import scan

# ---- evidence and candidates ------------------------------------------------------------------------------------

_SNIP = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_LIT = lambda v: sql_text(v) if v is not None else "NULL"


def _rule(i: int, r) -> str:
    cols = f"{sql_text(r.label)} AS label, '{r.kind}' AS kind, '{r.strength}' AS strength, {_LIT(r.provider)} AS provider, {_LIT(r.wrapper)} AS wrapper, '{r.family}' AS family, '{r.sdk}' AS sdk"
    if r.every:
        model, base = ("m", "NULL") if r.hint == "model" else ("NULL", "m")
        return (
            f"SELECT repo_id, path, n, line, {i} * 1000 + mi AS ord, {cols}, {model} AS model_hint, {base} AS base_url_hint FROM "
            f"(SELECT repo_id, path, n, line, unnest(ms) AS m, generate_subscripts(ms, 1) AS mi FROM (SELECT *, regexp_extract_all(line, {sql_text(r.pattern)}) AS ms FROM al))"
        )
    base = _SNIP.format("line") if r.hint == "base_url" else "NULL"
    return f"SELECT repo_id, path, n, line, {i} * 1000 AS ord, {cols}, NULL AS model_hint, {base} AS base_url_hint FROM al WHERE {rx('line', r.pattern)}"


_ENV = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ENV_PROVIDER.items()) + " END"
_ENVFAM = "CASE m " + " ".join(f"WHEN '{r.label[4:]}' THEN '{r.family}'" for r in R.RULES if r.kind == "env") + " END"
EV_CTES = [
    f"asrc AS (SELECT * FROM files WHERE {surface_where('api-surfaces')})",
    "al AS (SELECT repo_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM asrc))",
    "er AS ("
    + " UNION ALL ".join(_rule(i, r) for i, r in enumerate(R.LINE_RULES))
    + f" UNION ALL SELECT repo_id, path, n, line, {len(R.LINE_RULES)} * 1000 + mi, 'env-' || m, 'env', 'strong', {_ENV}, NULL, {_ENVFAM}, {_ENV}, NULL, NULL FROM (SELECT repo_id, path, n, line, unnest(ms) AS m, generate_subscripts(ms, 1) AS mi FROM (SELECT *, regexp_extract_all(line, {sql_text(R.ENV_PATTERN)}) AS ms FROM al)))",
    f"ew AS (SELECT *, {S.SUFFIX} AS sfx FROM er)",
    f"ex AS (SELECT *, sfx IN {S.sql_in(R.DOCS)} OR (sfx IN ('.py', '.pyi') AND regexp_matches(line, '^\\s*#')) OR (sfx IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs') AND regexp_matches(line, '^\\s*(?://|/\\*|\\*)')) AS weak FROM ew)",
    f"ev AS (SELECT repo_id, path, n AS line, ord, {_SNIP.format('line')} AS snippet, label, kind, CASE WHEN weak THEN 'weak' ELSE strength END AS strength, CASE WHEN weak THEN 'docs' WHEN sfx IN {S.sql_in(R.CODE)} THEN 'code' ELSE 'config' END AS source, "
    "CASE WHEN sfx IN ('.py', '.pyi') THEN 'python' WHEN sfx IN ('.ts', '.tsx') THEN 'typescript' WHEN sfx IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript' ELSE 'unknown' END AS language, coalesce(provider, '') AS provider, coalesce(wrapper, '') AS wrapper, family, sdk, coalesce(model_hint, '') AS model_hint, coalesce(base_url_hint, '') AS base_url_hint FROM ex)",
    "ck AS (SELECT * FROM ev WHERE source <> 'docs')",
    "ca AS (SELECT repo_id, provider, wrapper, family, count(*) AS n, count(*) FILTER (WHERE strength = 'strong') AS strong, bool_or(kind = 'base-url') AS host FROM ck GROUP BY 1, 2, 3, 4)",
    "cm AS (SELECT repo_id, provider, wrapper, family, language FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, provider, wrapper, family ORDER BY c DESC, f) AS rn FROM (SELECT repo_id, provider, wrapper, family, language, count(*) AS c, min((path, line, ord)) AS f FROM ck GROUP BY 1, 2, 3, 4, 5)) WHERE rn = 1)",
    "cs AS (SELECT repo_id, provider, wrapper, family, sdk FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, provider, wrapper, family ORDER BY c DESC, f) AS rn FROM (SELECT repo_id, provider, wrapper, family, sdk, count(*) AS c, min((path, line, ord)) AS f FROM ck GROUP BY 1, 2, 3, 4, 5)) WHERE rn = 1)",
    "cd AS (SELECT ca.*, language, sdk AS primary_sdk, CASE WHEN provider <> '' AND strong > 0 THEN 'provider-resolved' WHEN wrapper <> '' THEN 'wrapper-resolved' WHEN family <> 'unknown' THEN 'family-resolved' ELSE 'ambiguous' END AS level, least(strong, 2) + host::INT AS score FROM ca JOIN cm USING (repo_id, provider, wrapper, family) JOIN cs USING (repo_id, provider, wrapper, family))",
]


def evidence_of(spark, sf):
    return A.collect(corpus(spark, sf))


@query("api_line_evidence", with_files(*EV_CTES[:6], select="SELECT repo_id, path, CAST(line AS INTEGER) AS line, snippet, label, kind, strength, source, language, provider, wrapper, family, sdk, model_hint, base_url_hint FROM ev"))
def api_line_evidence(spark, sf):
    e = A.line_evidence(corpus(spark, sf))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("provider", "wrapper", "model_hint", "base_url_hint")}
    return e.withColumns(blank).drop("ord", "version_hint")


#: A rule and an alias that the library does not have, as a user would add them.
USER_RULE = (1000, "event-bus-publish", r"(?i:\bpublish\s*\()", "wrapper-sdk", "medium", None, "event-bus", "generic-wrapper", "event-bus", False, None)
_USER = R.SurfaceRule(*(USER_RULE[1], USER_RULE[2], USER_RULE[3], USER_RULE[4], USER_RULE[7], USER_RULE[8], USER_RULE[5], USER_RULE[6]))
RULED_CTES = [EV_CTES[0], EV_CTES[1], EV_CTES[2][:-1] + " UNION ALL " + _rule(len(R.RULES), _USER) + ")", *EV_CTES[3:6]]


def user_rules(spark):
    """The built-in rules and one more, written as JSON lines and read as a user's table."""
    path = stage_path(spark, "rules")
    built_in = A.rule_table(spark)
    built_in.unionByName(spark.createDataFrame([USER_RULE], built_in.schema)).write.json(path)
    return read_rules(spark, path)


@query("api_rule_evidence", with_files(*RULED_CTES, select="SELECT repo_id, path, CAST(line AS INTEGER) AS line, snippet, label, kind, strength, source, language, provider, wrapper, family, sdk, model_hint, base_url_hint FROM ev"))
def api_rule_evidence(spark, sf):
    """Evidence by a rule table on storage that holds a rule of the user's own."""
    e = A.table_evidence(corpus(spark, sf), user_rules(spark))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("provider", "wrapper", "model_hint", "base_url_hint")}
    return e.withColumns(blank).drop("ord", "version_hint")


@query("api_candidates", with_files(*EV_CTES, select="SELECT repo_id, provider, wrapper, family, n, level, CASE WHEN score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence, language, primary_sdk FROM cd"))
def api_candidates(spark, sf):
    return A.candidates(evidence_of(spark, sf)).drop("first")


_TURN = "ORDER BY joined, k, f"


def _telling(value: str, out: str, nothing: str) -> str:
    return f"coalesce(first({value} {_TURN}) FILTER (WHERE NOT ({nothing})), first({value} {_TURN})) AS {out}"


_LOOSE = S.sql_in(A.LOOSE)
SURFACE_CTES = [
    "cf AS (SELECT repo_id, provider, wrapper, family, min((path, line, ord)) AS f FROM ck GROUP BY 1, 2, 3, 4)",
    "co AS (SELECT cd.*, f, CASE WHEN level = 'provider-resolved' THEN provider ELSE '' END AS own, CASE WHEN score >= 3 THEN 0 WHEN score >= 2 THEN 1 ELSE 2 END AS conf FROM cd JOIN cf USING (repo_id, provider, wrapper, family))",
    "cl AS (SELECT repo_id, own, wrapper, family, level, row_number() OVER (PARTITION BY repo_id ORDER BY min(f), own, wrapper, family, level) AS k FROM co GROUP BY 1, 2, 3, 4, 5)",
    "mb AS (SELECT co.*, k FROM co JOIN cl USING (repo_id, own, wrapper, family, level))",
    "pg AS (SELECT DISTINCT ck.repo_id, ck.path, k FROM ck JOIN mb USING (repo_id, provider, wrapper, family))",
    "mt AS (SELECT DISTINCT x.repo_id, x.k, y.k AS k2 FROM pg x JOIN pg y ON x.repo_id = y.repo_id AND x.path = y.path AND x.k <> y.k)",
    # one row per class and round; a repository drops out after the round in which nothing joins
    f"""st AS (SELECT 0 AS it, repo_id, k, level, family, k AS home, 0 AS turn FROM cl UNION ALL
  SELECT s.it + 1, s.repo_id, s.k, s.level, CASE WHEN s.k = b.k2 AND s.family IN {S.sql_in(R.VAGUE)} AND b.family NOT IN {S.sql_in(R.VAGUE)} THEN b.family ELSE s.family END,
   CASE WHEN s.k = b.k THEN b.k2 ELSE s.home END, CASE WHEN s.k = b.k THEN s.it + 1 ELSE s.turn END
  FROM st s JOIN (SELECT v.repo_id, min({{'k': v.k, 'k2': t.k, 'family': v.family}}) AS b FROM st v JOIN st t ON v.repo_id = t.repo_id AND v.k <> t.k
    LEFT JOIN (SELECT DISTINCT mt.repo_id, mt.k, m.home FROM mt JOIN st m ON m.repo_id = mt.repo_id AND m.k = mt.k2) q ON q.repo_id = v.repo_id AND q.k = v.k AND q.home = t.k
    WHERE v.home = v.k AND t.home = t.k AND v.level IN {S.sql_in(A.WEAK)} AND t.level IN {S.sql_in(A.FIRM)} AND (t.family = v.family OR t.family = 'generic-wrapper' OR (v.family IN {_LOOSE} AND q.k IS NOT NULL))
    GROUP BY v.repo_id) p ON s.repo_id = p.repo_id)""",
    "fi AS (SELECT * FROM (SELECT *, max(it) OVER (PARTITION BY repo_id) AS last FROM st) WHERE it = last)",
    f"""h2 AS (SELECT v.repo_id, v.k, min(t.k) AS home FROM fi v JOIN mt ON mt.repo_id = v.repo_id AND mt.k = v.k JOIN fi m ON m.repo_id = mt.repo_id AND m.k = mt.k2 JOIN fi t ON t.repo_id = m.repo_id AND t.k = m.home
  WHERE v.home = v.k AND v.level = 'family-resolved' AND v.family IN {_LOOSE} AND t.k <> v.k AND t.home = t.k AND t.level = 'family-resolved' AND t.family NOT IN {_LOOSE} GROUP BY 1, 2)""",
    "pl AS (SELECT mb.*, coalesce(h2.home, fi.home) AS home, CASE WHEN h2.home IS NOT NULL THEN 1000000 ELSE fi.turn END AS joined FROM mb JOIN fi ON fi.repo_id = mb.repo_id AND fi.k = mb.k LEFT JOIN h2 ON h2.repo_id = mb.repo_id AND h2.k = mb.k)",
    "sr AS (SELECT repo_id, home, "
    + ", ".join(
        [
            _telling("family", "surface_family", f"family IN {S.sql_in(R.VAGUE)}"),
            _telling("own", "surface_provider", "own = ''"),
            _telling("wrapper", "surface_wrapper", "wrapper = ''"),
            f"first(level {_TURN}) AS level",
            "['high', 'medium', 'low'][min(conf) + 1] AS confidence",
            _telling("language", "language", "language = 'unknown'"),
            _telling("primary_sdk", "primary_sdk", "primary_sdk IN ('unknown', 'generic-wrapper')"),
        ]
    )
    + " FROM pl GROUP BY 1, 2)",
    "sn AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.LEVEL_RANK.items()) + " END, surface_family, primary_sdk, home) AS INTEGER) AS surface FROM sr)",
    "se AS (SELECT ck.*, surface FROM ck JOIN pl USING (repo_id, provider, wrapper, family) JOIN sn ON sn.repo_id = ck.repo_id AND sn.home = pl.home)",
]


def recursive(*ctes: str, select: str) -> str:
    return with_files(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "api_surfaces",
    recursive(*EV_CTES, *SURFACE_CTES, select="SELECT repo_id, surface, surface_family, surface_provider, surface_wrapper, level, confidence, language, primary_sdk, format('surface-{:03d}', surface) AS surface_id FROM sn"),
)
def api_surfaces(spark, sf):
    """Surfaces with their homes resolved."""
    ev = evidence_of(spark, sf)
    return A.surface_rows(A.surfaces(A.candidates(ev), ev))


@query(
    "api_surface_findings",
    recursive(
        *EV_CTES, *SURFACE_CTES,
        select="""SELECT repo_id, format('surface-{:03d}', surface) AS surface_id, CASE WHEN level = 'ambiguous' THEN 'provider-ambiguous' ELSE 'gateway-resolution-gap' END AS kind, '.' AS path, 0 AS line, '' AS label, 'low' AS severity
 FROM sn WHERE level = 'ambiguous' OR (level = 'wrapper-resolved' AND surface_provider = '')
 UNION ALL SELECT repo_id, format('surface-{:03d}', max(surface)), 'legacy-suspicion', path, CAST(line AS INTEGER), label, 'low' FROM se GROUP BY repo_id, path, line, label HAVING bool_or(kind = 'legacy-suspicion')""",
    ),
)
def api_surface_findings(spark, sf):
    ev = evidence_of(spark, sf)
    return A.detect(A.surfaces(A.candidates(ev), ev), ev)


@query(
    "api_surface_hints",
    recursive(
        *EV_CTES, *SURFACE_CTES,
        select="SELECT DISTINCT repo_id, surface, hint, value FROM (SELECT repo_id, surface, 'model' AS hint, model_hint AS value FROM se UNION ALL SELECT repo_id, surface, 'base_url', base_url_hint FROM se) WHERE value <> ''",
    ),
)
def api_surface_hints(spark, sf):
    ev = evidence_of(spark, sf)
    return A.hints(ev, A.surfaces(A.candidates(ev), ev))


@query("api_freshness_verdict", with_files(*EV_CTES[:7], select="SELECT r.repo_id, CASE WHEN count(ck.path) = 0 THEN 'not-applicable' ELSE 'triage' END AS verdict FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN ck USING (repo_id) GROUP BY 1"))
def api_freshness_verdict(spark, sf):
    files = corpus(spark, sf)
    ev = A.collect(files)
    return A.verdicts(files, A.surfaces(A.candidates(ev), ev)).select("repo_id", "verdict")


# ---- manifests --------------------------------------------------------------------------------------------------

PACKAGE = """'{"name": "p", "dependencies": {"openai": "^4.' || doc_id || '", "left-pad": "1"}, "devDependencies": {"@ai-sdk/google": "2"}}'"""
REQS = "'openai==1.' || doc_id || chr(10) || '# litellm' || chr(10) || chr(10) || '  LiteLLM>=1 ' || chr(10) || '-r base.txt'"
PROJECT = "'[project]' || chr(10) || 'dependencies = [\"anthropic>=0.3\", \"numpy\"]' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || 'python = \"3\"' || chr(10) || 'langchain = \"^0.1\"'"
DEP_FILES = f"df AS (SELECT source AS repo_id, 'p' || doc_id || '/' || CASE doc_id % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements-dev.txt' ELSE 'pyproject.toml' END AS path, doc_id, doc_id % 3 AS k FROM documents)"
DEP_ROWS = (
    "(VALUES (0, 'package', 'dependencies', 'openai', '^4.', 1, 1), (0, 'package', 'dependencies', 'left-pad', '1', 0, 1), (0, 'package', 'devDependencies', '@ai-sdk/google', '2', 0, 1), "
    "(1, 'requirements', '', 'openai', 'openai==1.', 1, 1), (1, 'requirements', '', 'LiteLLM', 'LiteLLM>=1', 0, 4), "
    "(2, 'project', 'project', 'anthropic', 'anthropic>=0.3', 0, 1), (2, 'project', 'project', 'numpy', 'numpy', 0, 1), (2, 'project', 'poetry', 'langchain', 'langchain^0.1', 0, 1)) t(k, manifest, section, name, spec, tail, line)"
)
DEPS = f"dd AS (SELECT repo_id, path, manifest, section, name, spec || CASE WHEN tail = 1 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS spec, CAST(line AS INTEGER) AS line FROM df JOIN {DEP_ROWS} USING (k))"


def dep_files(spark, sf):
    n = F.col("doc_id") % 3
    name = F.when(n == 0, "package.json").when(n == 1, "requirements-dev.txt").otherwise("pyproject.toml")
    text = f"CASE doc_id % 3 WHEN 0 THEN {PACKAGE} WHEN 1 THEN {REQS} ELSE {PROJECT} END".replace("chr(10)", "char(10)")
    return D.documents(spark, sf).select(
        F.col("source").alias("repo_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), F.expr(text).alias("text")
    ).withColumn("size_bytes", F.octet_length("text").cast("long"))


@query("manifest_dependencies", f"WITH {DEP_FILES}, {DEPS} SELECT * FROM dd")
def manifest_dependencies(spark, sf):
    return manifest_deps(dep_files(spark, sf)).drop("pos")


@query(
    "manifest_evidence",
    f"WITH {DEP_FILES}, {DEPS}, al(name, provider, wrapper, family, sdk) AS (VALUES " + ", ".join("(" + ", ".join(_LIT(x) for x in a) + ")" for a in R.ALIASES) + ") "
    "SELECT repo_id, path, line, CASE manifest WHEN 'package' THEN 'manifest-' || dd.name WHEN 'project' THEN 'pyproject-' || lower(dd.name) ELSE 'requirements-' || lower(dd.name) END AS label, CASE WHEN provider IS NOT NULL THEN 'strong' ELSE 'medium' END AS strength, "
    "family, CASE WHEN manifest = 'package' THEN dd.name || '@' || spec ELSE spec END AS version_hint FROM dd JOIN al ON al.name = lower(dd.name)",
)
def manifest_evidence(spark, sf):
    e = A.manifest_evidence(dep_files(spark, sf), A.alias_table(spark))
    return e.select("repo_id", "path", "line", "label", "strength", "family", "version_hint")


@query("manifest_alias_evidence", ORACLES["manifest_evidence"])
def manifest_alias_evidence(spark, sf):
    """Declared packages by an alias table read from a hints document on storage."""
    path = stage_path(spark, "hints")
    alias = F.struct("provider", "wrapper", F.col("family").alias("surface_family"), "sdk")
    whole = A.alias_table(spark).agg(F.map_from_entries(F.collect_list(F.struct(F.upper("name"), alias))).alias("package_aliases"))
    whole.write.json(path)
    e = A.manifest_evidence(dep_files(spark, sf), read_aliases(spark, path))
    return e.select("repo_id", "path", "line", "label", "strength", "family", "version_hint")


DATED = """de AS (SELECT source AS repo_id, format('surface-{:03d}', doc_id % 6 + 1) AS surface_id, 'lib' || (doc_id % 2) AS library_id, 'ref' || (doc_id // 2 % 2) AS source_ref,
  CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'failed' END AS status, DATE '2024-01-01' + CAST(doc_id * 37 % 500 AS INTEGER) AS checked_at FROM documents),
 da AS (SELECT repo_id, surface_id, library_id, source_ref, status, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, surface_id, library_id, source_ref ORDER BY checked_at DESC, status) AS rn
   FROM de WHERE checked_at <= DATE '2025-01-01') WHERE rn = 1 AND DATE '2025-01-01' - checked_at < 90)"""


def dated_evidence(spark, sf):
    """Checks of documents at days before and after the date of the audit, some of surfaces that do not exist."""
    n = F.col("doc_id")
    rows = D.documents(spark, sf).select(
        F.col("source").alias("repo_id"), F.format_string("surface-%03d", n % 6 + 1).alias("surface_id"), F.concat(F.lit("lib"), (n % 2).cast("string")).alias("library_id"),
        F.concat(F.lit("ref"), F.floor(n / 2 % 2).cast("string")).alias("source_ref"), F.when(n % 3 == 0, "verified").otherwise("failed").alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n * 37 % 500).cast("int")).alias("checked_at"),
    )
    return A.evidence_as_of(rows, "2025-01-01", 90)


@query("doc_evidence_as_of", f"WITH {DATED} SELECT repo_id, surface_id, library_id, source_ref, status, checked_at::VARCHAR AS checked_at FROM da")
def doc_evidence_as_of(spark, sf):
    return dated_evidence(spark, sf).withColumn("checked_at", F.col("checked_at").cast("string"))


@query("doc_evidence_unknown_surfaces", recursive(*EV_CTES, *SURFACE_CTES, DATED, select="SELECT * EXCLUDE (checked_at) FROM da WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.repo_id = da.repo_id AND format('surface-{:03d}', sn.surface) = da.surface_id)"))
def doc_evidence_unknown_surfaces(spark, sf):
    ev = evidence_of(spark, sf)
    own = A.surface_rows(A.surfaces(A.candidates(ev), ev))
    return A.unknown_surfaces(dated_evidence(spark, sf), own).drop("checked_at")


@query(
    "api_verified_verdict",
    recursive(
        *EV_CTES, *SURFACE_CTES, DATED,
        select="""SELECT r.repo_id, CASE WHEN NOT EXISTS (SELECT 1 FROM sn WHERE sn.repo_id = r.repo_id) THEN 'not-applicable'
 WHEN EXISTS (SELECT 1 FROM da JOIN sn ON sn.repo_id = da.repo_id AND format('surface-{:03d}', sn.surface) = da.surface_id WHERE da.repo_id = r.repo_id AND status = 'verified') THEN 'verified' ELSE 'triage' END AS verdict
 FROM (SELECT DISTINCT repo_id FROM files) r""",
    ),
)
def api_verified_verdict(spark, sf):
    """Surfaces of the files, document checks as they stood at a date, and the verdict that both give."""
    files = corpus(spark, sf)
    ev = A.collect(files)
    resolved = stage(A.surfaces(A.candidates(ev), ev), "surfaces")
    rows = A.verdicts(files, resolved).select("repo_id", "verdict")
    return A.verified_verdicts(rows, dated_evidence(spark, sf), A.surface_rows(resolved))


# ---- document evidence ------------------------------------------------------------------------------------------



def doc_evidence(spark, sf, half: int):
    n = F.col("doc_id")
    return D.documents(spark, sf).where(n % 2 == half).select(
        F.col("source").alias("repo_id"), F.concat(F.lit("s"), (n % 5).cast("string")).alias("surface_id"), F.concat(F.lit("lib"), (n % 3).cast("string")).alias("library_id"),
        F.concat(F.lit("ref"), F.floor(n / 2 % 2).cast("string")).alias("source_ref"), F.when(n % 4 == 0, "verified").otherwise("failed").alias("status"), F.concat(F.lit("n"), n.cast("string")).alias("notes"),
    )


@query(
    "doc_evidence_merge",
    "WITH e AS (SELECT source AS repo_id, 's' || (doc_id % 5) AS surface_id, 'lib' || (doc_id % 3) AS library_id, 'ref' || (doc_id // 2 % 2) AS source_ref, CASE WHEN doc_id % 4 = 0 THEN 'verified' ELSE 'failed' END AS status, 'n' || doc_id AS notes, doc_id % 2 AS o FROM documents) "
    "SELECT repo_id, surface_id, library_id, source_ref, status, arg_min(notes, (o, notes)) AS notes FROM e GROUP BY 1, 2, 3, 4, 5",
)
def doc_evidence_merge(spark, sf):
    return A.merge_doc_evidence(doc_evidence(spark, sf, 0), doc_evidence(spark, sf, 1))


# ---- validation -------------------------------------------------------------------------------------------------

_PY = lambda lst: f"'missing keys: [''' || array_to_string({lst}, ''', ''') || ''']'"
_LACK = lambda ks, have: f"list_sort(list_filter({S.sql_array(ks)}, lambda x: NOT list_contains({have}, x)))"
_X = lambda k: f"coalesce(json_extract_string(j, '$.{k}'), '')"
_ISL = lambda k: f"coalesce(json_type(j, '$.{k}'), '') = 'ARRAY'"
_PAIRS = ", ".join(f"'{d}/{x}'" for d, m in C.VERDICT_BUCKETS.items() for x in m)


def _v(order: int, cond: str, path: str, message: str, src: str = "ok") -> str:
    return f"SELECT repo_id, domain, {order} AS ord, {path} AS json_path, {message} AS message FROM {src} WHERE {cond}"


def _items(key: str) -> str:
    return f"(SELECT repo_id, domain, unnest(fs) AS f, '{key}[' || (generate_subscripts(fs, 1) - 1) || ']' AS p FROM (SELECT *, CAST(json_extract(j, '$.{key}') AS JSON[]) AS fs FROM ok WHERE {_ISL(key)}))"


_FK = "CASE WHEN json_type(f) = 'OBJECT' THEN json_keys(f) ELSE [] END"
_FX = lambda k: f"coalesce(CASE WHEN json_type(f) = 'OBJECT' THEN f->>'{k}' END, '')"
SUMMARY_VIOLATIONS = " UNION ALL ".join(
    [
        "SELECT repo_id, domain, 0 AS ord, 'summary' AS json_path, 'not a JSON object' AS message FROM vj WHERE j IS NULL OR json_type(j) <> 'OBJECT'",
        _v(1, f"len({_LACK(V.TOP_KEYS, 'ks')}) > 0", "'summary'", _PY(_LACK(V.TOP_KEYS, "ks"))),
        _v(2, f"{_X('dependency_status')} NOT IN ('ready', 'auto-installed', 'blocked')", "'dependency_status'", f"'invalid dependency_status: ' || {_X('dependency_status')}"),
        _v(3, f"domain || '/' || {_X('overall_verdict')} NOT IN ({_PAIRS})", "'overall_verdict'", f"'invalid overall_verdict: ' || {_X('overall_verdict')}"),
        _v(4, f"{_X('rollup_bucket')} NOT IN ('blocked', 'red', 'yellow', 'green', 'not-applicable')", "'rollup_bucket'", f"'invalid rollup_bucket: ' || {_X('rollup_bucket')}"),
        _v(5, f"NOT {_ISL('bootstrap_actions')}", "'bootstrap_actions'", "'must be a list'"),
        _v(6, f"NOT {_ISL('dependency_failures')}", "'dependency_failures'", "'must be a list'"),
        _v(7, f"{_X('dependency_status')} = 'blocked' AND NOT ({_ISL('dependency_failures')} AND json_array_length(j, '$.dependency_failures') > 0)", "'dependency_failures'", "'blocked requires at least one failure'"),
        _v(8, f"NOT {_ISL('findings')}", "'findings'", "'must be a list'"),
        *[_v(9 + i, f"coalesce(json_type(j, '$.severity_counts.{s}'), '') NOT IN ('BIGINT', 'UBIGINT')", f"'severity_counts.{s}'", "'must be an integer'") for i, s in enumerate(("critical", "high", "medium", "low"))],
        f"SELECT repo_id, domain, 21, p, {_PY(_LACK(V.FAILURE_KEYS, _FK))} FROM {_items('dependency_failures')} WHERE len({_LACK(V.FAILURE_KEYS, _FK)}) > 0",
        f"SELECT repo_id, domain, 22, p, {_PY(_LACK(V.FINDING_KEYS, _FK))} FROM {_items('findings')} WHERE len({_LACK(V.FINDING_KEYS, _FK)}) > 0",
        f"SELECT repo_id, domain, 23, p, 'invalid severity: ' || {_FX('severity')} FROM {_items('findings')} WHERE {_FX('severity')} NOT IN ('critical', 'high', 'medium', 'low')",
        f"SELECT repo_id, domain, 24, p, 'invalid confidence: ' || {_FX('confidence')} FROM {_items('findings')} WHERE {_FX('confidence')} NOT IN ('high', 'medium', 'low')",
    ]
)
VCTES = "WITH " + D.summaries_cte() + ",\nvj AS (SELECT repo_id, domain, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS j, CASE WHEN json_valid(json) THEN json_keys(CAST(json AS JSON)) ELSE [] END AS ks FROM summaries),\nok AS (SELECT * FROM vj WHERE j IS NOT NULL AND json_type(j) = 'OBJECT')\n"


@query("validate_summaries", VCTES + SUMMARY_VIOLATIONS)
def validate_summaries(spark, sf):
    return V.validate_summaries(D.summaries(spark, sf))


@query("validate_summaries_first", VCTES + f", vv AS ({SUMMARY_VIOLATIONS}) SELECT repo_id, domain, CAST(min(ord) AS INTEGER) AS ord FROM vv GROUP BY 1, 2")
def validate_summaries_first(spark, sf):
    return V.first_violations(V.validate_summaries(D.summaries(spark, sf), first=True), ["repo_id", "domain"]).select("repo_id", "domain", "ord")


SURF = """'{"audit_mode": "' || mode || '", "overall_verdict": "' || CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE mode END || '", "dependency_status": "ready", "surface_resolution": [' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '{"surface_id": "s1", "resolution_level": "' || CASE WHEN doc_id % 6 = 0 THEN 'odd' ELSE 'ambiguous' END || '"}' END
 || '], "doc_verification": [{"surface_id": "s' || (doc_id % 2 + 1) || '", "status": "' || CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'failed' END || '"}], "findings": [{"surface_id": "s1", "severity": "' || CASE WHEN doc_id % 4 = 0 THEN 'high' ELSE 'low' END || '", "resolution_level": "family-resolved", "verification_status": "' || CASE WHEN doc_id % 8 = 0 THEN 'verified' ELSE 'not-run' END || '"}]}'"""
MODES = ["triage", "verified", "blocked", "not-applicable", "strange"]


@query(
    "validate_surface_summaries",
    f"WITH d AS (SELECT 'd' || doc_id AS repo_id, doc_id, ({S.sql_array(MODES)})[doc_id % 5 + 1] AS mode FROM documents) "
    + " UNION ALL ".join(
        f"SELECT repo_id, {o} AS ord, '{p}' AS json_path, {m} AS message FROM d WHERE {c}"
        for o, p, m, c in [
            (0, "audit_mode", "'invalid audit_mode: strange'", "mode = 'strange'"),
            (1, "overall_verdict", "'must equal audit_mode'", "doc_id % 7 = 0"),
            (2, "audit_mode", "'blocked mode requires blocked dependency_status'", "mode = 'blocked'"),
            (3, "doc_verification", "'verified mode requires a verified entry'", "mode = 'verified' AND doc_id % 3 <> 0"),
            (4, "surface_resolution", "'not-applicable mode has no surfaces'", "mode = 'not-applicable' AND doc_id % 5 <> 0"),
            (10, "surface_resolution[0]", "'invalid resolution_level: odd'", "doc_id % 5 <> 0 AND doc_id % 6 = 0"),
            (11, "doc_verification[0]", "'unknown surface_id'", "doc_id % 5 <> 0 AND doc_id % 2 = 1"),
            (15, "findings[0]", "'triage findings may not exceed low'", "mode = 'triage' AND doc_id % 4 = 0"),
            (16, "findings[0]", "'family-resolved findings may not exceed medium'", "doc_id % 4 = 0"),
            (17, "findings[0]", "'high-severity findings require verified docs'", "doc_id % 4 = 0 AND doc_id % 8 <> 0"),
            (18, "findings[0]", "'verified audit may not contain not-run findings'", "mode = 'verified' AND doc_id % 8 <> 0"),
        ]
    ),
)
def validate_surface_summaries(spark, sf):
    n = F.col("doc_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (n % 5 + 1).cast("int"))
    d = D.documents(spark, sf).select(F.concat(F.lit("d"), n.cast("string")).alias("repo_id"), "doc_id", mode.alias("mode"))
    return V.validate_surface_summaries(d.select("repo_id", F.expr(SURF).alias("json")))


@query("validate_rollup", RUNS_WITH + " SELECT repo_id, domain, 2 AS ord, 'dependency_status' AS json_path, 'unsupported dependency_status' AS message FROM runs WHERE dependency_status NOT IN ('ready', 'auto-installed', 'blocked')")
def validate_rollup(spark, sf):
    """The roll-up's own output against its contract: only summaries that carried an unknown status fail."""
    return V.validate_rollup(runs_of(spark, sf).withColumn("run_id", F.lit(D.RUN_ID)), D.RUN_ID)


CONTRACT = """'{"schema_version": "' || CASE WHEN doc_id % 6 = 0 THEN '2.0' ELSE '1.0' END || '", "skill": "' || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE skill END || '", "overall_verdicts": ["a", "b"], "rollup_map": {"a": "green", "' || CASE WHEN doc_id % 3 = 0 THEN 'c' ELSE 'b' END || '": "' || CASE WHEN doc_id % 4 = 0 THEN 'pink' ELSE 'red' END || '"}' || CASE WHEN doc_id % 7 = 0 THEN ', "note": 1' ELSE '' END || '}'"""
MANIFEST = """CASE WHEN doc_id % 9 = 0 THEN 'nope' ELSE '{"schema_version": "1", "skill": "' || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE skill END || '", "runtime_features": ' || CASE WHEN doc_id % 4 = 0 THEN '{}' ELSE '["f"]' END || ', "tools": ' || CASE WHEN doc_id % 3 = 0 THEN '["t", 1]' ELSE '[]' END || CASE WHEN doc_id % 7 = 0 THEN ', "note": 1' ELSE '' END || '}' END"""
NAMED = "WITH d AS (SELECT 'k' || doc_id AS skill, doc_id FROM documents) "


def named(spark, sf, text):
    n = F.col("doc_id")
    d = D.documents(spark, sf).select(F.concat(F.lit("k"), n.cast("string")).alias("skill"), "doc_id")
    return d.select("skill", F.expr(text).alias("json"))


@query(
    "validate_contracts",
    NAMED + " UNION ALL ".join(
        f"SELECT skill, {o} AS ord, '{p}' AS json_path, {m} AS message FROM d WHERE {c}"
        for o, p, m, c in [
            (1, "contract", "'unsupported keys: note'", "doc_id % 7 = 0"),
            (2, "schema_version", "'must be 1.0'", "doc_id % 6 = 0"),
            (3, "skill", "'must equal its own name'", "doc_id % 5 = 0"),
            (5, "rollup_map", "'missing verdicts: b'", "doc_id % 3 = 0"),
            (6, "rollup_map", "'unexpected verdicts: c'", "doc_id % 3 = 0"),
            (7, "rollup_map", "'invalid buckets for: ' || CASE WHEN doc_id % 3 = 0 THEN 'c' ELSE 'b' END", "doc_id % 4 = 0"),
        ]
    ),
)
def validate_contracts(spark, sf):
    return V.validate_contracts(named(spark, sf, CONTRACT))


@query(
    "validate_manifests",
    NAMED + " UNION ALL ".join(
        f"SELECT skill, {o} AS ord, '{p}' AS json_path, '{m}' AS message FROM d WHERE {c}"
        for o, p, m, c in [
            (0, "manifest", "must be valid JSON", "doc_id % 9 = 0"),
            (1, "manifest", "unsupported keys: note", "doc_id % 9 <> 0 AND doc_id % 7 = 0"),
            (3, "skill", "must equal its own name", "doc_id % 9 <> 0 AND doc_id % 5 = 0"),
            (4, "runtime_features", "must be a list", "doc_id % 9 <> 0 AND doc_id % 4 = 0"),
            (7, "tools", "must contain only strings", "doc_id % 9 <> 0 AND doc_id % 3 = 0"),
        ]
    ),
)
def validate_manifests(spark, sf):
    return V.validate_manifests(named(spark, sf, MANIFEST))


# ---- run state --------------------------------------------------------------------------------------------------

_DOM = S.sql_array(list(C.DOMAINS))
UPDATES = (
    f"up AS (SELECT 'r' || (user_id % 10) AS run_id, ({_DOM})[user_id % {len(C.DOMAINS)} + 1] AS domain, event_id AS seq, CASE WHEN event_id % 4 <> 0 THEN event_type END AS runtime_status, CASE WHEN event_id % 3 = 0 THEN props END AS detail, "
    "CASE WHEN event_id % 5 = 0 THEN 'note ' || event_id END AS notes, CASE WHEN event_id % 7 = 0 THEN 'v' || (event_id % 4) END AS child_verdict, CASE WHEN event_id % 2 = 0 THEN 's/' || event_id END AS summary_path FROM events)"
)
STATE_SQL = f"WITH {UPDATES} SELECT run_id, domain, " + ", ".join(f"max_by({f}, seq) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in X.FIELDS) + ", max(seq) AS last_seq FROM up GROUP BY 1, 2"


def as_updates(e):
    n, u = F.col("event_id"), F.col("user_id")
    domains = F.array(*[F.lit(d) for d in C.DOMAINS])
    return e.select(
        F.concat(F.lit("r"), (u % 10).cast("string")).alias("run_id"), F.element_at(domains, (u % len(C.DOMAINS) + 1).cast("int")).alias("domain"), n.alias("seq"),
        F.when(n % 4 != 0, F.col("event_type")).alias("runtime_status"), F.when(n % 3 == 0, F.col("props")).alias("detail"),
        F.when(n % 5 == 0, F.concat(F.lit("note "), n.cast("string"))).alias("notes"), F.when(n % 7 == 0, F.concat(F.lit("v"), (n % 4).cast("string"))).alias("child_verdict"),
        F.when(n % 2 == 0, F.concat(F.lit("s/"), n.cast("string"))).alias("summary_path"),
    )


@query("run_state_batch", STATE_SQL)
def run_state_batch(spark, sf):
    return X.latest_fields(as_updates(spark.read.parquet(f"{sf}/events.parquet")))


@query("run_state_stream", STATE_SQL)
def run_state_stream(spark, sf):
    """The same state from a stream of the events; every micro-batch appends its updates."""
    base = f"{checkpoint_root(spark)}/run-state-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = X.worker_state(as_updates(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out/batch=*")
    newest = rows.groupBy("run_id", "domain").agg(F.max_by(F.struct(*X.FIELDS, "last_seq"), "last_seq").alias("s"))
    return newest.select("run_id", "domain", "s.*")


@query(
    "run_state_current_run",
    f"WITH {UPDATES} SELECT run_id, domain, count(*) AS n FROM up WHERE run_id = 'r3' GROUP BY 1, 2",
)
def run_state_current_run(spark, sf):
    e = X.reject_stale(as_updates(spark.read.parquet(f"{sf}/events.parquet")), "r3")
    return e.groupBy("run_id", "domain").agg(F.count(F.lit(1)).alias("n"))


STAGE_LIST = ["preflight", "bootstrapping", "running", "complete", "blocked", "not-applicable", "odd", "complete", "invalid"]
REC = (
    f"rc AS (SELECT 'run-7' AS want, CASE WHEN k % 19 = 0 THEN 'run-6' ELSE 'run-7' END AS run_id, repo_id || '/' || domain AS domain, domain || '-audit' AS expected_skill, CASE WHEN k % 17 = 0 THEN 'x' ELSE domain || '-audit' END AS skill, "
    f"({S.sql_array(STAGE_LIST)})[k % {len(STAGE_LIST)} + 1] AS stage, CASE k % 13 WHEN 0 THEN 'blocked' WHEN 1 THEN 'weird' ELSE 'ready' END AS dependency_status, CASE WHEN k % 5 = 0 THEN 'doing ' || k ELSE '' END AS current_action, "
    "k % 23 <> 0 AS actions_list, k % 29 <> 0 AS failures_list, k % 31 = 0 AS short, CASE WHEN k % 11 = 0 THEN '' ELSE 's/' || (k % 50) END AS summary_path, 'r/' || (k % 40) AS report_path, 'b/' || (k % 30) AS agent_brief_path FROM sk)"
)
_LOST = (
    "concat_ws('; ', CASE WHEN summary_path = '' THEN 'summary path missing' WHEN CAST(substr(summary_path, 3) AS INTEGER) % 10 = 0 THEN 'summary artifact missing at ' || summary_path END, "
    "CASE WHEN CAST(substr(report_path, 3) AS INTEGER) % 10 = 0 THEN 'report artifact missing at ' || report_path END, CASE WHEN CAST(substr(agent_brief_path, 3) AS INTEGER) % 10 = 0 THEN 'agent-brief artifact missing at ' || agent_brief_path END)"
)
_FAULT = (
    "CASE WHEN short THEN 'runtime missing required keys: [''stage'']' WHEN NOT actions_list THEN 'runtime bootstrap_actions must be a list' WHEN NOT failures_list THEN 'runtime dependency_failures must be a list' "
    "WHEN dependency_status = 'weird' THEN 'runtime dependency_status invalid: weird' WHEN run_id <> want THEN 'run_id mismatch: expected run-7, got ' || run_id WHEN skill <> expected_skill THEN 'skill mismatch: expected ' || expected_skill || ', got ' || skill "
    f"WHEN stage IN ('complete', 'blocked', 'not-applicable') AND {_LOST} <> '' THEN {_LOST} END"
)
_STATUS = "CASE WHEN dependency_status = 'blocked' OR stage = 'blocked' THEN 'blocked' WHEN stage = 'odd' THEN 'waiting' ELSE stage END"
_DETAIL = f"CASE WHEN current_action <> '' THEN current_action ELSE CASE {_STATUS} WHEN 'blocked' THEN '{X.BLOCKED_DETAIL}' WHEN 'waiting' THEN '{X.WAITING_DETAIL}' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STAGES.items()) + " END END"
SYNC = f"sy AS (SELECT run_id, domain, CASE WHEN {_FAULT} IS NOT NULL THEN 'invalid' ELSE {_STATUS} END AS runtime_status, coalesce({_FAULT}, {_DETAIL}) AS detail FROM rc)"


def synced(spark, sf):
    k = F.col("k")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGE_LIST]), (k % len(STAGE_LIST) + 1).cast("int"))
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    keys = F.array(*[F.lit(x) for x in X.REQUIRED])
    rec = D.summary_keys(spark, sf).select(
        F.when(k % 19 == 0, "run-6").otherwise("run-7").alias("run_id"), F.concat_ws("/", "repo_id", "domain").alias("domain"),
        F.concat("domain", F.lit("-audit")).alias("expected_skill"), F.when(k % 17 == 0, "x").otherwise(F.concat("domain", F.lit("-audit"))).alias("skill"),
        stage.alias("stage"), F.when(k % 13 == 0, "blocked").when(k % 13 == 1, "weird").otherwise("ready").alias("dependency_status"),
        F.when(k % 5 == 0, F.concat(F.lit("doing "), k.cast("string"))).otherwise("").alias("current_action"),
        (k % 23 != 0).alias("actions_list"), (k % 29 != 0).alias("failures_list"), F.when(k % 31 == 0, F.array_remove(keys, "stage")).otherwise(keys).alias("keys"),
        F.when(k % 11 == 0, "").otherwise(text("s/", 50)).alias("summary_path"), text("r/", 40).alias("report_path"), text("b/", 30).alias("agent_brief_path"),
    )
    paths = F.array(text("s/", 50), text("r/", 40), text("b/", 30))
    arts = D.summary_keys(spark, sf).select(F.explode(paths).alias("path")).where(F.substring("path", F.lit(3), F.length("path")).cast("int") % 10 != 0)
    return X.sync_runtime(rec, D.RUN_ID, arts)


@query("run_sync", "WITH " + D.summaries_cte() + f", {REC}, {SYNC} SELECT * FROM sy")
def run_sync(spark, sf):
    return synced(spark, sf)


@query("run_progress", "WITH " + D.summaries_cte() + f", {REC}, {SYNC} SELECT run_id, round(avg(CASE WHEN runtime_status IN {S.sql_in(X.FINAL)} THEN 1.0 ELSE 0.0 END), 9) AS completion, round(0.2 + avg(CASE WHEN runtime_status IN {S.sql_in(X.FINAL)} THEN 1.0 ELSE 0.0 END) * 0.6, 9) AS progress, 'running' AS stage, 'RUNNING (Audits Active)' AS state_label, 'running' AS state_tone FROM sy GROUP BY 1")
def run_progress(spark, sf):
    p = X.progress(synced(spark, sf))
    return p.withColumns({c: F.round(c, 9) for c in ("completion", "progress")})


@query("incremental_scan", with_files(CLEAN_CTE, select=f"SELECT {FOUND_COLS} FROM found"))
def incremental_scan(spark, sf):
    base = f"{checkpoint_root(spark)}/scan-{uuid.uuid4().hex}"
    corpus(spark, sf).select("repo_id", "path", "text", "size_bytes").write.parquet(f"{base}/in")
    scan.scan_stream(spark, f"{base}/in", f"{base}/out", lambda files: detect_files(files, AS_OF), f"{base}/cp").awaitTermination()
    return shown(scan.current_findings(spark, f"{base}/out"))
