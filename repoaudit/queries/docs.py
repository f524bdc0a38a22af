"""Queries over links, document contracts, tree comparison and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.operators import documents as DO
from repoaudit.operators import links as L
from repoaudit.plans.cleanup import docs_roots, evidence_gaps, manifests, repo_profile, stale_links
from repoaudit.queries import derived as D
from repoaudit.queries import sqlgen as S
from repoaudit.queries.contracts import MANIFEST_FILES, manifest_files
from repoaudit.queries.derived import corpus
from repoaudit.queries.registry import query
from repoaudit.queries.sqlgen import surface_where, with_files

SLUG = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s+', '-', 'g'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
)
# normalise "dir/../x" by folding the parts
NORM = (
    "array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split({0}, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s])), "
    "lambda acc, s: CASE WHEN s[1] = '..' THEN acc[:-2] ELSE list_concat(acc, s) END), '/')"
)


def link_ctes(source: str, pattern_by_suffix: str) -> list[str]:
    return [
        f"lk0 AS (SELECT repo_id, path AS source, text, unnest(ts) AS target, generate_subscripts(ts, 1) - 1 AS ord FROM (SELECT repo_id, path, text, {pattern_by_suffix} AS ts FROM {source}))",
        f"lk AS (SELECT repo_id, source, ord, target, {S.line_of('text', 'target')} AS line, {S.strip('target')} AS t FROM lk0)",
        "lr AS (SELECT *, regexp_matches(t, '^(?:https?://|mailto:|tel:)') AS external, string_split(string_split(t, '#')[1], '?')[1] AS bare, CASE WHEN contains(t, '#') THEN substr(t, strpos(t, '#') + 1) END AS anchor, array_to_string(string_split(source, '/')[:-2], '/') AS dir FROM lk)",
        "lj AS (SELECT *, CASE WHEN bare = '' THEN source WHEN starts_with(bare, '/') THEN NULL ELSE CASE WHEN dir = '' THEN bare ELSE dir || '/' || bare END END AS joined FROM lr)",
        f"lp AS (SELECT * EXCLUDE (joined), CASE WHEN bare = '' THEN source WHEN joined IS NOT NULL THEN {NORM.format('joined')} END AS resolved FROM lj)",
    ]


MD = "regexp_extract_all(text, '!?\\[[^\\]]*\\]\\(([^)]+)\\)', 1)"
DOC_LINKS = link_ctes(f"(SELECT * FROM files WHERE {surface_where('doc-links')})", f"CASE WHEN {S.SUFFIX} IN ('.md', '.mdx') THEN {MD} ELSE [] END")
CHECK = [
    "ex AS (SELECT DISTINCT repo_id, unnest(list_transform(range(1, len(ps) + 1), lambda n: array_to_string(ps[:n], '/'))) AS path FROM (SELECT repo_id, string_split(path, '/') AS ps FROM files))",
    "fd AS (SELECT lp.*, CASE WHEN e0.path IS NOT NULL THEN e0.path WHEN NOT regexp_matches(regexp_extract(resolved, '[^/]*$'), '^.+\\.[^.]+$') THEN coalesce(e1.path, e2.path) END AS found FROM lp LEFT JOIN ex e0 ON e0.repo_id = lp.repo_id AND e0.path = resolved LEFT JOIN ex e1 ON e1.repo_id = lp.repo_id AND e1.path = resolved || '/index.md' LEFT JOIN ex e2 ON e2.repo_id = lp.repo_id AND e2.path = resolved || '/README.md' WHERE NOT external)",
    f"an AS (SELECT DISTINCT repo_id, path, {SLUG.format(S.strip('h'))} AS anchor FROM (SELECT repo_id, path, unnest(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1)) AS h FROM files))",
    "br AS (SELECT repo_id, source, target, line, 'missing-path' AS reason FROM fd WHERE found IS NULL UNION ALL SELECT fd.repo_id, source, target, line, CASE WHEN fi.path IS NULL THEN 'anchor-target-unreadable' ELSE 'missing-anchor' END FROM fd LEFT JOIN an ON an.repo_id = fd.repo_id AND an.path = found AND an.anchor = fd.anchor LEFT JOIN (SELECT DISTINCT repo_id, path FROM files) fi ON fi.repo_id = fd.repo_id AND fi.path = found WHERE found IS NOT NULL AND coalesce(fd.anchor, '') <> '' AND an.anchor IS NULL)",
]


@query("doc_links", with_files(*DOC_LINKS, select="SELECT repo_id, source, CAST(ord AS INTEGER) AS ord, target, CAST(line AS INTEGER) AS line, external, coalesce(resolved, '') AS resolved, coalesce(nullif(anchor, ''), '') AS anchor FROM (SELECT * EXCLUDE (resolved), CASE WHEN NOT external THEN resolved END AS resolved FROM lp)"))
def doc_links(spark, sf):
    r = L.resolve(L.extract_links(corpus(spark, sf)))
    return r.select("repo_id", "source", "ord", "target", "line", "external", F.coalesce("resolved", F.lit("")).alias("resolved"), F.coalesce("anchor", F.lit("")).alias("anchor"))


@query("doc_broken_links", with_files(*DOC_LINKS, *CHECK, select="SELECT repo_id, source, target, CAST(line AS INTEGER) AS line, reason FROM br"))
def doc_broken_links(spark, sf):
    return L.check_links(corpus(spark, sf)).drop("ord")


@query("doc_stale_link_findings", with_files(*DOC_LINKS, *CHECK, select="SELECT DISTINCT repo_id, source AS path, 'stale-doc-reference' AS category, CAST(line AS INTEGER) AS line, reason || ': ' || target AS evidence FROM br"))
def doc_stale_link_findings(spark, sf):
    found = stale_links(L.check_links(corpus(spark, sf)))
    return found.select("repo_id", "path", "category", "line", F.array_join("evidence", " | ").alias("evidence")).distinct()


@query("doc_anchors", with_files(CHECK[2], select="SELECT * FROM an"))
def doc_anchors(spark, sf):
    return L.anchors(corpus(spark, sf))


PAGES = "files AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, 'site/page_' || page_id || '.html' AS path, html AS text, strlen(html) AS size_bytes FROM pages)"
PAGE_LINKS = link_ctes("files", "regexp_extract_all(text, '(?i)(?:href|src)=[\"'']([^\"'']+)[\"'']', 1)")


def page_files(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("repo_id"),
        F.concat(F.lit("site/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("text"),
        F.octet_length("html").cast("long").alias("size_bytes"),
    )


@query("page_broken_links", "WITH " + ",\n".join([PAGES, *PAGE_LINKS, *CHECK]) + "\nSELECT repo_id, source, target, CAST(line AS INTEGER) AS line, reason FROM br")
def page_broken_links(spark, sf):
    return L.check_links(page_files(spark, sf)).drop("ord")


@query("page_escaping_links", "WITH " + ",\n".join([PAGES, *PAGE_LINKS]) + "\nSELECT repo_id, source, target, CAST(line AS INTEGER) AS line FROM lp WHERE NOT external AND bare <> '' AND starts_with(bare, '/')")
def page_escaping_links(spark, sf):
    return L.escaping_links(page_files(spark, sf))


# documents as contract files: every third has a well-formed head
HEAD = {
    0: "---\nname: src{s}\ndescription: Audits things. Use for checks.\n---\n# Title\n\n## Should Trigger\n\n- one case\n",
    1: "---\nname: Bad_Name\ndescription: \"Reports in 2024\"\nno colon here\n---\n## should trigger\nprose only\n## Other\n",
    2: "---\nname: open\n",
    3: "plain start\n",
}


def head_sql(spark_side: bool) -> str:
    arms = []
    for k, v in HEAD.items():
        text = v.replace("src{s}", "{S}")
        parts = [D.sql_text(p) for p in text.split("{S}")]
        arms.append(f"WHEN {k} THEN " + " || source || ".join(parts))
    return "CASE doc_id % 4 " + " ".join(arms) + " END"


DOCS = f"docs AS (SELECT source AS doc_set, 'doc_' || doc_id || '.md' AS path, {head_sql(False)} || text AS text, doc_id FROM documents)"


def contract_docs(spark, sf):
    d = D.documents(spark, sf)
    return d.select(
        F.col("source").alias("doc_set"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.expr(head_sql(True).replace("chr(10)", "char(10)")), F.col("text")).alias("text"),
    )


_BODY = "length(text) - length(replace(text, chr(10), '')) + 1"
V_DOCS = (
    "SELECT doc_set, path, ord, message FROM ("
    "SELECT *, 0 AS ord, 'must start with frontmatter delimiter' AS message FROM docs WHERE doc_id % 4 = 3"
    " UNION ALL SELECT *, 1, 'frontmatter is not closed' FROM docs WHERE doc_id % 4 = 2"
    " UNION ALL SELECT *, 2, 'frontmatter lines must use key: value format' FROM docs WHERE doc_id % 4 = 1"
    " UNION ALL SELECT *, 5, 'name Bad_Name must match directory name ' || doc_set FROM docs WHERE doc_id % 4 = 1"
    " UNION ALL SELECT *, 6, 'name must be kebab-case' FROM docs WHERE doc_id % 4 = 1"
    f" UNION ALL SELECT *, 7, 'body must stay under 500 lines' FROM docs WHERE {_BODY} - CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 0 END >= 500"
    " UNION ALL SELECT *, 9, 'description must start with an allowed prefix' FROM docs WHERE doc_id % 4 = 1"
    " UNION ALL SELECT *, 10, 'description must contain its trigger phrase' FROM docs WHERE doc_id % 4 = 1"
    " UNION ALL SELECT *, 11, 'time-sensitive literal' FROM docs WHERE regexp_matches(text, '\\b20\\d{2}\\b')"
    " UNION ALL SELECT *, 12, 'missing required section ## Should Trigger' FROM docs WHERE doc_id % 4 IN (2, 3)"
    " UNION ALL SELECT *, 13, 'section ## Should Trigger must contain at least one concrete case' FROM docs WHERE doc_id % 4 = 1"
    " UNION ALL SELECT *, 14, 'required phrase missing: case' FROM docs WHERE NOT contains(text, 'case')"
    " UNION ALL SELECT *, 15, 'forbidden phrase present: prose only' FROM docs WHERE contains(text, 'prose only'))"
)


@query("document_contract", f"WITH {DOCS}\n{V_DOCS}")
def document_contract(spark, sf):
    return DO.validate_documents(contract_docs(spark, sf), sections=["Should Trigger"], required=["case"], forbidden=["prose only"])


@query(
    "document_sections",
    f"WITH {DOCS} SELECT path, CASE doc_id % 4 WHEN 0 THEN substr(text, strpos(text, '## Should')) WHEN 1 THEN '## should trigger' || chr(10) || 'prose only' || chr(10) ELSE '' END AS body FROM docs",
)
def document_sections(spark, sf):
    return contract_docs(spark, sf).select("path", DO.section(F.col("text"), "Should Trigger").alias("body"))


# second tree: some documents dropped, some changed, some added
TREE_B = """b AS (SELECT source AS repo_id, 'doc_' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 5 <> 0
 UNION ALL SELECT source, 'new_' || doc_id, text FROM documents WHERE doc_id % 11 = 0)"""


def trees(spark, sf):
    d = D.documents(spark, sf)
    n = F.col("doc_id")
    a = d.select(F.col("source").alias("repo_id"), F.concat(F.lit("doc_"), n.cast("string")).alias("path"), F.col("text").alias("content"))
    kept = d.where(n % 5 != 0).select(
        F.col("source").alias("repo_id"), F.concat(F.lit("doc_"), n.cast("string")).alias("path"),
        F.when(n % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"),
    )
    added = d.where(n % 11 == 0).select(F.col("source").alias("repo_id"), F.concat(F.lit("new_"), n.cast("string")).alias("path"), F.col("text").alias("content"))
    return a, kept.unionByName(added)


@query(
    "tree_diff",
    f"WITH a AS (SELECT source AS repo_id, 'doc_' || doc_id AS path, text AS content FROM documents), {TREE_B} SELECT repo_id, path, CASE WHEN b.content IS NULL THEN 'missing' WHEN a.content IS NULL THEN 'extra' ELSE 'mismatch' END AS state FROM a FULL OUTER JOIN b USING (repo_id, path) WHERE a.content IS NULL OR b.content IS NULL OR a.content <> b.content",
)
def tree_diff(spark, sf):
    a, b = trees(spark, sf)
    return DO.diff_trees(a, b, ["repo_id", "path"])


@query(
    "derived_copy_drift",
    """WITH copies AS (SELECT 'doc_' || doc_id AS name, source AS path, doc_id % 3 AS k FROM documents WHERE doc_id % 4 <> 0)
 SELECT 'doc_' || d.doc_id AS name, coalesce(c.path, '') AS path, CASE WHEN c.name IS NULL THEN 'missing' ELSE 'out-of-sync' END AS state FROM documents d LEFT JOIN copies c ON c.name = 'doc_' || d.doc_id WHERE c.name IS NULL OR c.k = 1""",
)
def derived_copy_drift(spark, sf):
    d = D.documents(spark, sf)
    n = F.col("doc_id")
    name = F.concat(F.lit("doc_"), n.cast("string"))
    canonical = d.select(name.alias("name"), "text")
    good = DO.derived_content(name, F.col("text"))
    copies = d.where(n % 4 != 0).select(name.alias("name"), F.col("source").alias("path"), F.when(n % 3 == 1, F.concat(good, F.lit("edited"))).otherwise(good).alias("text"))
    return DO.diff_derived(canonical, copies)


SETS = """a AS (SELECT DISTINCT 'p' || l_partkey AS name FROM lineitem ), m AS (SELECT 'p' || p_partkey + CASE WHEN p_size % 7 = 0 THEN 1000000 ELSE 0 END AS name FROM part WHERE p_size % 2 = 0), e AS (SELECT 'p' || p_partkey + CASE WHEN p_size % 5 = 0 THEN 2000000 ELSE 0 END AS name FROM part WHERE p_size % 4 = 1)"""


@query(
    "set_drift",
    f"WITH {SETS} SELECT name, 'unmanaged' AS reason FROM a WHERE name NOT IN (SELECT name FROM m) AND name NOT IN (SELECT name FROM e) UNION ALL SELECT name, 'unknown-managed' FROM m WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT name, 'unknown-exempt' FROM e WHERE name NOT IN (SELECT name FROM a)",
)
def set_drift(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("name")
    # every part is managed, exempt or neither by its size; some names have no line item
    part = part.withColumn("managed", F.col("p_partkey") + F.when(F.col("p_size") % 7 == 0, 1_000_000).otherwise(0)).withColumn(
        "exempt", F.col("p_partkey") + F.when(F.col("p_size") % 5 == 0, 2_000_000).otherwise(0)
    )
    actual = li.select(name("l_partkey")).distinct()
    return DO.set_drift(actual, part.where("p_size % 2 = 0").select(name("managed")), part.where("p_size % 4 = 1").select(name("exempt")))


@query("shared_paths", f"WITH a AS (SELECT source AS repo_id, 'doc_' || doc_id AS path FROM documents), {TREE_B} SELECT DISTINCT repo_id, path FROM a JOIN b USING (repo_id, path)")
def shared_paths(spark, sf):
    a, b = trees(spark, sf)
    return DO.shared(a, b, ["repo_id", "path"])


@query(
    "workspace_directories",
    "WITH " + MANIFEST_FILES + " SELECT DISTINCT repo_id, CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:-2], '/') ELSE '.' END AS directory FROM mf WHERE regexp_matches(path, '(?:^|/)(?:package\\.json|pyproject\\.toml)$')",
)
def workspace_directories(spark, sf):
    f = manifest_files(spark, sf)
    dirs = lambda n: f.where(P.name(F.col("path")) == n).select("repo_id", P.parent(F.col("path")).alias("directory"))
    return DO.union_distinct(dirs("package.json"), dirs("pyproject.toml"))


@query("manifests", "WITH " + MANIFEST_FILES + " SELECT repo_id, path, k AS kind FROM mf JOIN (VALUES ('package-lock.json', 'node'), ('yarn.lock', 'node'), ('poetry.lock', 'python'), ('Pipfile', 'python'), ('requirements.txt', 'python'), ('package.json', 'node'), ('pyproject.toml', 'python')) t(n, k) ON regexp_extract(path, '[^/]*$') = n")
def manifest_rows(spark, sf):
    return manifests(manifest_files(spark, sf))


@query("docs_roots", "WITH " + MANIFEST_FILES + " SELECT DISTINCT repo_id, 'docs' AS docs_root FROM mf WHERE path LIKE 'docs/%'")
def docs_root_rows(spark, sf):
    return docs_roots(manifest_files(spark, sf))


NOISE_DIRS = ["pkg/__pycache__", "pkg", "agents", "src"]
NOISE_NAMES = ["a.pyc", "README.md", "mod.py"]


@query(
    "packaging_noise",
    f"WITH nf AS (SELECT source AS repo_id, ({S.sql_array(NOISE_DIRS)})[doc_id % 4 + 1] || '/' || doc_id || '/' || ({S.sql_array(NOISE_NAMES)})[doc_id % 3 + 1] AS p0, ({S.sql_array(NOISE_DIRS)})[doc_id % 4 + 1] || '/' || ({S.sql_array(NOISE_NAMES)})[doc_id % 3 + 1] AS p1, doc_id FROM documents), nn AS (SELECT repo_id, CASE WHEN doc_id % 2 = 0 THEN p1 ELSE p0 END AS path FROM nf) "
    "SELECT repo_id, path, CASE WHEN path LIKE '%__pycache__%' THEN 'cache-directory' WHEN path LIKE '%.pyc' THEN 'compiled-file' ELSE 'placeholder-document' END AS kind FROM nn WHERE path LIKE '%__pycache__%' OR path LIKE '%.pyc' OR regexp_matches(path, '(?:^|/)agents/README\\.md$')",
)
def packaging_noise(spark, sf):
    d = D.documents(spark, sf)
    n = F.col("doc_id")
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    path = F.when(n % 2 == 0, F.concat_ws("/", pick(NOISE_DIRS), pick(NOISE_NAMES))).otherwise(F.concat_ws("/", pick(NOISE_DIRS), n.cast("string"), pick(NOISE_NAMES)))
    return DO.packaging_noise(d.select(F.col("source").alias("repo_id"), path.alias("path")))




@query(
    "cleanup_evidence_gaps",
    "WITH " + MANIFEST_FILES + ", g AS (SELECT repo_id, bool_or(path <> 'docs/index.md' AND path <> 'pnpm-lock.yaml') AS manifest FROM mf GROUP BY 1) "
    "SELECT repo_id, '.' AS path, 'evidence-gap' AS category, 'high' AS severity FROM g UNION ALL SELECT repo_id, '.', 'evidence-gap', 'medium' FROM g UNION ALL SELECT repo_id, '.', 'scan-blocker', 'medium' FROM g WHERE NOT manifest",
)
def cleanup_evidence_gaps(spark, sf):
    """Repositories without tests, CI or known manifests."""
    return evidence_gaps(manifest_files(spark, sf)).select("repo_id", "path", "category", "severity")


@query(
    "cleanup_repo_profile",
    "WITH " + MANIFEST_FILES + """, g AS (SELECT repo_id, count(DISTINCT path) FILTER (WHERE path NOT IN ('docs/index.md', 'pnpm-lock.yaml')) AS n_manifests, bool_or(path LIKE '%package.json') AS js, bool_or(regexp_matches(path, '(?:pyproject.toml|requirements.txt|Pipfile)$')) AS py, bool_or(path LIKE 'docs/%') AS docs,
 bool_or(regexp_matches(path, '(?:package.json|package-lock.json|yarn.lock)$')) AS node, bool_or(regexp_matches(path, '(?:pyproject.toml|requirements.txt|Pipfile|poetry.lock)$')) AS python FROM mf GROUP BY 1)
 SELECT repo_id, n_manifests, CASE WHEN docs THEN 1 ELSE 0 END::BIGINT AS n_docs_roots, array_to_string(list_sort(list_concat(CASE WHEN node THEN ['node'] ELSE [] END, CASE WHEN python THEN ['python'] ELSE [] END, CASE WHEN js THEN ['tsc', 'eslint', 'knip', 'ast-grep'] ELSE [] END, CASE WHEN py THEN ['ruff', 'basedpyright', 'tach'] ELSE [] END, CASE WHEN docs THEN ['lychee', 'vale', 'built-in-link-check'] ELSE [] END)), ',') AS tool_hints FROM g""",
)
def cleanup_repo_profile(spark, sf):
    return repo_profile(manifest_files(spark, sf)).select("repo_id", "n_manifests", "n_docs_roots", F.array_join("tool_hints", ",").alias("tool_hints"))
