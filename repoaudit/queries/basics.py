"""Queries over path, text and counting operators, report rows, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions import text as T
from repoaudit.functions.regex import bank, extract_first, fold, has_any
from repoaudit.functions.secrets import is_placeholder
from repoaudit.operators import findings as FI
from repoaudit.operators.links import document_slug, heading_slug
from repoaudit.plans import cleanup, reports, side_effects
from repoaudit.plans import categories as CA
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.base import AS_OF, CLEAN_CTE, SE_FLAGS, SE_LINES, SE_SURFACE
from repoaudit.queries.derived import corpus, sql_text
from repoaudit.queries.docs import SLUG
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import rx, with_files
from repoaudit.rules import categories as CR
from repoaudit.rules import cleanup as CL
from repoaudit.rules import surface as SU
from repoaudit.sources.corpus import surface_coverage, surface_note

_P = "string_split(path, '/')"
_LP = "string_split(lower(path), '/')"


@query(
    "path_flags",
    with_files(
        select=f"""SELECT repo_id, path, {S.SUFFIX} AS suffix, {S.NAME} AS name, {S.SUFFIX} IN {S.sql_in(SU.DOC_SUFFIXES)} AS is_doc, regexp_matches('/' || lower(path), {sql_text(SU.TEST_PATH.replace(chr(92) + 'z', '$'))}) AS is_test, {rx('path', CR.TEST_FILE)} AS is_test_by_parts,
 list_has_any({_LP}, {S.sql_array(SU.GENERATED_PARTS)}) AS is_generated, list_has_any({_LP}, {S.sql_array(SU.MIGRATION_PARTS)}) AS is_migration, {rx('path', SU.BOUNDARY_PATH)} AS is_boundary, {rx('path', SU.CI_CONFIG_PATH.replace(chr(92) + 'z', '$'))} AS is_ci,
 {rx('path', CL.SHIM_PATH)} AS is_shim, regexp_matches(path, '(?:^|/)\\.council-runtime/(?:.*/)?site-packages/') AS is_foreign, list_has_any({_LP}, ['domain', 'domains']) AS is_domain, {S.NAME} IN {S.sql_in(SU.ENTRYPOINT_NAMES)} AS is_entrypoint,
 CASE WHEN contains(path, '/') THEN array_to_string({_P}[:-2], '/') ELSE '.' END AS parent FROM files"""
    ),
)
def path_flags(spark, sf):
    p = F.col("path")
    return corpus(spark, sf).select(
        "repo_id", "path", P.suffix(p).alias("suffix"), P.name(p).alias("name"), P.is_doc(p).alias("is_doc"), P.is_test(p).alias("is_test"), P.is_test_by_parts(p).alias("is_test_by_parts"),
        P.is_generated(p).alias("is_generated"), P.is_migration(p).alias("is_migration"), P.is_boundary(p).alias("is_boundary"), P.is_ci_config(p).alias("is_ci"), p.rlike(CL.SHIM_PATH).alias("is_shim"),
        P.is_foreign_runtime(p).alias("is_foreign"), P.is_domain_file(p).alias("is_domain"), P.is_entrypoint(p).alias("is_entrypoint"), P.parent(p).alias("parent"),
    )


@query(
    "path_languages",
    with_files(select="SELECT repo_id, path, CASE " + " ".join(f"WHEN {S.SUFFIX} = '{k}' THEN '{v}'" for k, v in SU.LANGUAGE_BY_SUFFIX.items()) + " ELSE 'unknown' END AS language, CASE " + " ".join(f"WHEN {S.SUFFIX} = '{k}' THEN '{v}'" for k, v in SU.APPLICATION_LANGUAGE_BY_SUFFIX.items()) + " ELSE 'non-application' END AS application_language FROM files"),
)
def path_languages(spark, sf):
    p = F.col("path")
    return corpus(spark, sf).select("repo_id", "path", F.coalesce(P.language(p), F.lit("unknown")).alias("language"), F.coalesce(P.application_language(p), F.lit("non-application")).alias("application_language"))


@query("path_contexts", with_files(select="SELECT repo_id, path, string_split(lower(path), '/')[2] AS context FROM files WHERE path LIKE 'contexts/%'"))
def path_contexts(spark, sf):
    f = corpus(spark, sf).select("repo_id", "path", P.context_name(F.col("path")).alias("context"))
    return f.where("context is not null")


_MARK = f"list_concat({_LP}, [regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.[^.]+$', ''), {S.SUFFIX}])"
_TAGS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN list_has_any({_MARK}, {S.sql_array(SU.RESPONSIBILITY_MARKERS[t])}) THEN '{t}' END" for t in SU.RESPONSIBILITY_MARKERS) + "], lambda x: x IS NOT NULL))"


@query("path_responsibility_tags", with_files(select=f"SELECT repo_id, path, array_to_string({_TAGS}, ',') AS tags FROM files"))
def path_responsibility_tags(spark, sf):
    return corpus(spark, sf).select("repo_id", "path", F.array_join(P.responsibility_tags(P.strings([]), F.col("path")), ",").alias("tags"))


@query(
    "python_packages",
    with_files(select=f"SELECT DISTINCT repo_id, pkg FROM (SELECT repo_id, CASE WHEN {_P}[1] IN ('src', 'app', 'apps', 'services', 'packages') AND len({_P}) >= 2 THEN {_P}[2] END AS pkg FROM files WHERE path LIKE '%.py' UNION ALL SELECT repo_id, CASE WHEN {_P}[1] NOT IN ('scripts', 'tests') THEN string_split({_P}[1], '.')[1] END FROM files WHERE path LIKE '%.py') WHERE regexp_matches(pkg, '^[A-Za-z_]\\w*$')"),
)
def python_packages(spark, sf):
    py = corpus(spark, sf).where(F.col("path").endswith(".py"))
    return py.select("repo_id", F.explode(P.python_package(F.col("path"))).alias("pkg")).distinct()


@query("repo_scopes", with_files(select=f"SELECT repo_id, CASE WHEN count(DISTINCT {_P}[1]) FILTER (WHERE path LIKE '%.py') = 0 THEN 'no-python-surface' WHEN count(DISTINCT {_P}[1]) FILTER (WHERE path LIKE '%.py') > 1 THEN 'python-monorepo-or-multi-root' ELSE 'python-repo' END AS scope FROM files GROUP BY 1"))
def repo_scopes(spark, sf):
    """Scope from the number of distinct roots of Python files."""
    root = F.when(F.col("path").endswith(".py"), F.substring_index("path", "/", 1))
    n = corpus(spark, sf).select("repo_id", root.alias("root")).groupBy("repo_id").agg(F.countDistinct("root").alias("n"))
    return n.select("repo_id", F.when(F.col("n") == 0, "no-python-surface").when(F.col("n") > 1, "python-monorepo-or-multi-root").otherwise("python-repo").alias("scope"))


@query(
    "surface_notes",
    with_files(
        "x AS (SELECT repo_id, count(*) FILTER (WHERE NOT regexp_matches(path, '(?:^|/)\\.council-runtime/(?:.*/)?site-packages/')) AS first_party, count(*) FILTER (WHERE regexp_matches(path, '(?:^|/)\\.council-runtime/(?:.*/)?site-packages/')) AS foreign_excluded FROM files GROUP BY 1)",
        select="SELECT *, 'surface: first-party ' || first_party || ' | foreign-runtime excluded ' || foreign_excluded AS note FROM x",
    ),
)
def surface_notes(spark, sf):
    c = surface_coverage(corpus(spark, sf))
    return c.withColumn("note", surface_note(F.col("first_party"), F.col("foreign_excluded"), source=F.lit("git-index")))


@query("language_profile", with_files(select=f"SELECT repo_id, {S.SUFFIX} AS suffix, count(*) AS n FROM files GROUP BY 1, 2"))
def language_profile(spark, sf):
    return corpus(spark, sf).groupBy("repo_id", P.suffix(F.col("path")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


# ---- text -------------------------------------------------------------------------------------------------------


@query("exploded_lines", "WITH " + D.files_cte() + ", " + D.lines_cte() + " SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def exploded_lines(spark, sf):
    return T.explode_lines(corpus(spark, sf))


TODO = bank(r"\bdef\s+\w+", r"\bclass\s+\w+")


@query(
    "first_matching_lines",
    "WITH " + D.files_cte() + ", " + D.lines_cte() + f" SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, {S.strip('line')} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) AS rn FROM lines WHERE {rx('line', TODO)}) WHERE rn = 1",
)
def first_matching_lines(spark, sf):
    f = corpus(spark, sf).select("repo_id", "path", T.line_array(F.col("text")).alias("lines"))
    g = f.withColumn("line_no", T.first_match_line(F.col("lines"), TODO))
    return g.where("line_no is not null").select("repo_id", "path", "line_no", T.snippet(T.line_at(F.col("lines"), F.col("line_no"))).alias("snippet"))


NAMES = bank(r"class\s+(\w+)", r"def\s+(\w+)", r"import\s+\w+")


@query(
    "extracted_cues",
    with_files(
        f"x AS (SELECT repo_id, path, text, {S.extract_first('text', NAMES)} AS cue FROM files)",
        select=f"SELECT repo_id, path, cue, CAST({S.line_of('text', 'cue')} AS INTEGER) AS line FROM x WHERE cue IS NOT NULL",
    ),
)
def extracted_cues(spark, sf):
    f = corpus(spark, sf).withColumn("low", fold(F.col("text")))
    g = f.select("repo_id", "path", "text", extract_first(F.col("text"), NAMES, F.col("low")).alias("cue"))
    return g.where("cue is not null").select("repo_id", "path", "cue", T.line_of(F.col("text"), F.col("cue")).alias("line"))


TOKENS = ["import ", "return", "# ", "==", "aa"]


@query("token_counts", with_files(select="SELECT repo_id, path, CAST(" + " + ".join(f"(length(text) - length(replace(text, {sql_text(t)}, ''))) // {len(t)}" for t in TOKENS) + " AS INTEGER) AS n FROM files"))
def token_counts(spark, sf):
    return corpus(spark, sf).select("repo_id", "path", T.count_literals(F.col("text"), TOKENS).alias("n"))


HEADS = "hd AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^#{1,6}\\s+(.+?)\\s*$', 1)) AS heading FROM files UNION SELECT DISTINCT text FROM documents)"


@query("heading_slugs", with_files(HEADS, select=f"SELECT heading, {SLUG.format(S.strip('heading'))} AS slug FROM hd"))
def heading_slugs(spark, sf):
    c = corpus(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?md)^#{1,6}\s+(.+?)\s*$"), F.lit(1))).alias("heading"))
    d = D.documents(spark, sf).select(F.col("text").alias("heading"))
    return c.unionByName(d).distinct().select("heading", heading_slug(F.col("heading")).alias("slug"))


@query(
    "document_slugs",
    "SELECT DISTINCT lang || ' - ' || source AS heading, replace(regexp_replace(lower(lang || ' - ' || source), '[^\\w\\s-]', '', 'g'), ' ', '-') AS slug FROM documents",
)
def document_slugs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws(" - ", "lang", "source").alias("heading")).distinct()
    return d.select("heading", document_slug(F.col("heading")).alias("slug"))


SECRET = r"(?i)token\s*=\s*[\"']([0-9a-f]{40})[\"']"


@query("redacted_tokens", "SELECT doc_id, substr(regexp_extract(text, " + sql_text(SECRET) + ", 1), 1, 4) || '…' AS preview FROM documents WHERE regexp_matches(text, " + sql_text(SECRET) + ")")
def redacted_tokens(spark, sf):
    d = D.documents(spark, sf)
    return d.where(F.col("text").rlike(SECRET)).select("doc_id", T.redact(F.regexp_extract("text", SECRET, 1)).alias("preview"))


@query(
    "placeholder_lines",
    "WITH " + D.files_cte() + ", " + D.lines_cte() + f" SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no FROM lines WHERE {rx('line', CR.PLACEHOLDER)}",
)
def placeholder_lines(spark, sf):
    return T.explode_lines(corpus(spark, sf)).where(is_placeholder(F.col("line"))).select("repo_id", "path", "line_no")


@query("pattern_presence", with_files(select=f"SELECT repo_id, path, {rx('text', TODO)} AS hit FROM files"))
def pattern_presence(spark, sf):
    f = corpus(spark, sf).withColumn("low", fold(F.col("text")))
    return f.select("repo_id", "path", has_any(F.col("text"), TODO, F.col("low")).alias("hit"))


# ---- findings: order, numbers, reports --------------------------------------------------------------------------

_RANKED = "row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, coalesce(line, 0), category, title)"


@query("top_findings_report", with_files(CLEAN_CTE, select=f"SELECT repo_id, path, category, severity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_RANKED} AS rank FROM found) WHERE rank <= 5"))
def top_findings_report(spark, sf):
    return FI.top_findings(cleanup.detect_files(corpus(spark, sf), AS_OF), 5).select("repo_id", "path", "category", "severity", "rank")


@query(
    "report_rows",
    with_files(CLEAN_CTE, select=f"SELECT repo_id, 'cleanup' AS section, CAST(rank AS INTEGER) AS ord, severity || ' | ' || category || ' | ' || path || ':' || coalesce(line, 0) || ' | ' || title AS text FROM (SELECT *, {_RANKED} AS rank FROM found) WHERE rank <= 8"),
)
def report_rows(spark, sf):
    return reports.report_rows(cleanup.detect_files(corpus(spark, sf), AS_OF), "cleanup", 8)


@query(
    "numbered_finding_ids",
    with_files(SE_SURFACE, SE_FLAGS, SE_LINES, select="SELECT repo_id, 'dsh-' || lpad(CAST(rn AS VARCHAR), 3, '0') AS id, path, CAST(coalesce(line, 0) AS INTEGER) AS line FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line) AS rn FROM raw)"),
)
def numbered_finding_ids(spark, sf):
    found = side_effects.audit(corpus(spark, sf))[0]
    return FI.numbered_ids(found, "dsh").select("repo_id", "id", "path", F.coalesce("line", F.lit(0)).alias("line"))


@query("deduplicated_findings", "SELECT 'r' || (l_partkey % 20) AS repo_id, 'c' || l_linenumber AS category, 'p' || l_suppkey AS path, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1, 2, 3")
def deduplicated_findings(spark, sf):
    """First finding per key by emit order, over rows with many repeats."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.select(
        F.concat(F.lit("r"), (F.col("l_partkey") % 20).cast("string")).alias("repo_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("category"),
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), F.lit(1).alias("line"), F.lit("t").alias("title"), F.col("l_orderkey").alias("emit_ord"),
    )
    return FI.dedupe(rows).select("repo_id", "category", "path", F.col("emit_ord").alias("first_seen"))


@query("category_maps", with_files(CLEAN_CTE, select="SELECT repo_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT repo_id, category, count(*) AS n FROM found GROUP BY 1, 2) GROUP BY 1"))
def category_maps(spark, sf):
    m = FI.category_map(cleanup.detect_files(corpus(spark, sf), AS_OF))
    pairs = F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("repo_id", F.array_join(pairs, ",").alias("categories"))


@query("mode_values", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE rn = 1")
def mode_values(spark, sf):
    return FI.mode_first(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_type", "event_id")


@query("ordered_distinct_values", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS event_types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_values(spark, sf):
    d = FI.ordered_distinct(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_type", "event_id", "event_types")
    return d.withColumn("event_types", F.array_join("event_types", ","))


@query("ordered_distinct_rows", "SELECT l_returnflag, l_linestatus, l_partkey, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY f, l_partkey) AS INTEGER) AS seq FROM (SELECT l_returnflag, l_linestatus, l_partkey, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2, 3)")
def ordered_distinct_rows(spark, sf):
    """Parts of three large groups in order of first occurrence, as rows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return FI.ordered_distinct_rows(li, ["l_returnflag", "l_linestatus"], "l_partkey", "l_orderkey")


@query("top_value_lists", "SELECT user_id, string_agg(event_type, ',' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1")
def top_value_lists(spark, sf):
    t = FI.top_values(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_type", "event_id", 3)
    return t.withColumn("top", F.array_join("top", ","))


@query("running_numbers", "SELECT l_returnflag, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS seq FROM lineitem")
def running_numbers(spark, sf):
    """Dense numbers inside three groups that each hold about a third of the rows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return FI.number_within(li, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_partkey", "l_suppkey")


_STEPS, _DEFAULT = reports.ACTIONS["structure"]


@query(
    "action_lists",
    "WITH " + D.tool_runs_cte() + ", " + D.merged_runs_cte() + """, f AS (SELECT repo_id, bool_or(tool IN ('tach', 'dependency-cruiser') AND status = 'issues') AS a, bool_or(tool = 'knip' AND status = 'issues') AS b FROM merged GROUP BY 1)
 SELECT repo_id, CASE WHEN a AND b THEN """ + sql_text(_STEPS[0][1]) + " || ' | ' || " + sql_text(_STEPS[1][1]) + " WHEN a THEN " + sql_text(_STEPS[0][1]) + " WHEN b THEN " + sql_text(_STEPS[1][1]) + " ELSE " + sql_text(_DEFAULT) + " END AS actions FROM f",
)
def action_lists(spark, sf):
    from repoaudit.operators.tool_runs import merge_tool_runs

    m = merge_tool_runs(D.tool_runs(spark, sf))
    issues = F.col("status") == "issues"
    category = F.when(F.col("tool").isin("tach", "dependency-cruiser") & issues, "cycle").when((F.col("tool") == "knip") & issues, "unused-file").otherwise("none")
    return reports.actions(m.select("repo_id", category.alias("category")), "structure").withColumn("actions", F.array_join("actions", " | "))


@query(
    "verdict_summary_lines",
    "WITH v(domain, verdict, line) AS (VALUES " + ", ".join(f"('{k.split('/')[0]}', '{k.split('/')[1]}', {sql_text(t)})" for k, t in reports.SUMMARY_LINES.items()) + "), "
    + "p AS (SELECT doc_id, doc_id % " + str(len(reports.SUMMARY_LINES)) + " AS k FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY domain, verdict) - 1 AS k FROM v) SELECT doc_id, domain, verdict, line FROM p JOIN n USING (k)",
)
def verdict_summary_lines(spark, sf):
    keys = sorted(reports.SUMMARY_LINES, key=lambda k: tuple(k.split("/")))
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("doc_id") % len(keys) + 1).cast("int"))
    d = D.documents(spark, sf).select("doc_id", F.substring_index(key, "/", 1).alias("domain"), F.substring_index(key, "/", -1).alias("verdict"))
    return d.withColumn("line", reports.summary_line(F.col("domain"), F.col("verdict")))


# ---- secrets over raw documents: the flagship -------------------------------------------------------------------

RAW = "files AS (SELECT source AS repo_id, 'doc_' || doc_id || '.md' AS path, text FROM documents), ln AS (SELECT repo_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM files))"
RULE = CR.SECRETS.lines[0]


@query(
    "secret_exposure",
    f"WITH {RAW}, h AS (SELECT repo_id, count(*) AS hits, count(DISTINCT path) AS files FROM ln WHERE {rx('line', RULE.hits)} AND NOT {rx('line', RULE.unless)} GROUP BY 1) SELECT r.repo_id, coalesce(hits, 0) AS hits, coalesce(files, 0) AS files, CASE WHEN coalesce(hits, 0) > 0 THEN 'watch' ELSE 'clean' END AS verdict FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN h USING (repo_id)",
)
def secret_exposure(spark, sf):
    """High-signal secret material per source, every source kept: the flagship query."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    files = d.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text",
    ).withColumn("size_bytes", F.octet_length("text").cast("long"))
    per_file = CA.file_signals(files, CR.SECRETS).groupBy("repo_id").agg(
        F.sum("n_material").alias("hits"), F.count_if(F.col("n_material") > 0).alias("files")
    )
    return per_file.select("repo_id", "hits", "files", F.when(F.col("hits") > 0, "watch").otherwise("clean").alias("verdict"))


@query(
    "secret_history",
    f"WITH {D.files_cte()}, ln AS (SELECT repo_id, path, unnest(string_split(text, chr(10))) AS line FROM files WHERE NOT regexp_matches(path, '(?:^|/)\\.council-runtime/(?:.*/)?site-packages/')), h AS (SELECT repo_id, count(*) AS n FROM ln WHERE {rx('line', RULE.hits)} AND NOT {rx('line', RULE.unless)} GROUP BY 1)"
    " SELECT r.repo_id, 'history-exposure' AS category, CASE WHEN coalesce(n, 0) > 0 THEN 'watch' ELSE 'clean' END AS state FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN h USING (repo_id)",
)
def secret_history(spark, sf):
    """Historical content goes through the same detectors as the working tree."""
    files = corpus(spark, sf)
    history = files.select("repo_id", F.lit("c1").alias("commit"), "path", "text")
    states = CA.audit(files, "secrets-and-hardcode", history)[0]
    return states.where("category = 'history-exposure'").select("repo_id", "category", "state")




#: Text that two commits held and the tree no longer holds.
LEAKED = "aws_key = " + "AKIA" + "QWERTYUIOPASDFGH"


def commits_of(spark, sf):
    """Four commits: in two of them every seventh file holds a key that the tree does not, the others are as the tree."""
    files = corpus(spark, sf)
    leaked = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n" + LEAKED))).otherwise(F.col("text"))
    return files, files.select("repo_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(4)])).alias("commit"), "path", "text", leaked.alias("before")).select(
        "repo_id", "commit", "path", F.when(F.col("commit").isin("c0", "c1"), F.col("before")).otherwise(F.col("text")).alias("text")
    )


@query(
    "secret_history_exposures",
    f"WITH {D.files_cte()}, old AS (SELECT f.repo_id, f.path, f.text || chr(10) || {sql_text(LEAKED)} AS text FROM files f JOIN documents d ON d.doc_id = TRY_CAST(regexp_extract(f.path, 'doc_(\\d+)', 1) AS BIGINT) WHERE d.doc_id % 7 = 0 "
    "AND NOT regexp_matches(path, '(?:^|/)\\.council-runtime/(?:.*/)?site-packages/')), "
    "ln AS (SELECT repo_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM old)) "
    f"SELECT repo_id, path, count(*)::BIGINT AS hits, min(n)::INT AS line, 2::BIGINT AS commits FROM ln WHERE {rx('line', RULE.hits)} AND NOT {rx('line', RULE.unless)} GROUP BY 1, 2",
)
def secret_history_exposures(spark, sf):
    """Secret contents that commits hold and the tree no longer does."""
    files, history = commits_of(spark, sf)
    commits, blobs = CA.history_content(history)
    return CA.history_exposures(commits, CA.content_hits(blobs), files).select("repo_id", "path", F.col("hits").cast("long").alias("hits"), "line", "commits")
