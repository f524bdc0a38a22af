"""Category-state audits: one text pass per audit, then counters, states, findings and a verdict per repository."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import fold, guard, has_any, matches, strip
from repoaudit.functions.text import line_array, line_at, redact, snippet
from repoaudit.operators.findings import finding, per_repo, union_findings
from repoaudit.rules.categories import AUDITS, WORKFLOWS, CategoryAudit, LineRule, Scope
from repoaudit.sources.corpus import select_surface

SECRET_DOMAIN = "secrets-and-hardcode"


def in_scope(scope: Scope) -> Column:
    path = F.col("path")
    tests = []
    if scope.suffixes:
        tests.append(P.suffix(path).isin(list(scope.suffixes)))
    if scope.names:
        tests.append(P.name(path).isin(list(scope.names)))
    if scope.path:
        tests.append(matches(path, scope.path))
    if scope.name:
        tests.append(matches(P.name(path), scope.name))
    if scope.text:
        tests.append(matches(F.col("text"), scope.text, F.col("low")))
    return reduce(and_, tests) if tests else F.lit(True)


def rule_hits(rule: LineRule) -> Column:
    """Line numbers hit by a rule in this file; empty without touching lines when no needle occurs."""
    gates = [guard(F.col("low"), p) for p in rule.hits.each()]
    open_gate = F.lit(True) if any(g is None for g in gates) else reduce(or_, gates)

    def test(line: Column) -> Column:
        body = strip(line) if rule.stripped else line
        hit = has_any(body, rule.hits)
        return hit & ~has_any(body, rule.unless) if rule.unless else hit

    marked = F.transform(F.col("lines"), lambda x, i: F.when(test(x), i + 1))
    found = F.filter(marked, lambda n: n.isNotNull())
    return F.when(in_scope(rule.scope) & open_gate, found).otherwise(F.array().cast("array<int>"))


def file_signals(files: DataFrame, audit: CategoryAudit) -> DataFrame:
    """Per file: hit count and first hit of every line rule, and a flag per file rule. Texts end here."""
    src = select_surface(files, "text").withColumn("low", fold(F.col("text")))
    hits = src.withColumn("lines", line_array(F.col("text"))).select(
        "repo_id",
        "path",
        "lines",
        *[rule_hits(r).alias(f"h_{r.id}") for r in audit.lines],
        *[reduce(or_, [in_scope(s) for s in r.any_of]).alias(f"f_{r.id}") for r in audit.files],
    )
    hide = redact if audit.domain == SECRET_DOMAIN else (lambda c: c)

    def first(rule: LineRule) -> Column:
        at = F.try_element_at(F.col(f"h_{rule.id}"), F.lit(1))
        text = hide(snippet(line_at(F.col("lines"), at)))
        return F.when(at.isNotNull(), F.struct("path", at.alias("line"), text.alias("text"))).alias(f"at_{rule.id}")

    return hits.select(
        "repo_id",
        "path",
        *[F.size(f"h_{r.id}").alias(f"n_{r.id}") for r in audit.lines],
        *[first(r) for r in audit.lines],
        *[f"f_{r.id}" for r in audit.files],
    )


def repo_counters(signals: DataFrame, audit: CategoryAudit) -> DataFrame:
    """Sums and first locations per repository; everything combines map-side."""
    in_ci = F.col("path").contains(WORKFLOWS)
    return signals.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        *[F.sum(f"n_{r.id}").alias(f"n_{r.id}") for r in audit.lines],
        *[F.sum(F.when(in_ci, F.col(f"n_{r.id}")).otherwise(0)).alias(f"ci_{r.id}") for r in audit.lines],
        *[F.min(f"at_{r.id}").alias(f"at_{r.id}") for r in audit.lines],
        *[F.count_if(f"f_{r.id}").alias(f"f_{r.id}") for r in audit.files],
    )


def counters(files: DataFrame, domain: str) -> DataFrame:
    """Counters for every repository of ``files``, zero where its surface is empty."""
    audit = AUDITS[domain]
    found = repo_counters(file_signals(files, audit), audit)
    zero = [c for c in found.columns if c.startswith(("n_", "ci_", "f_", "files_"))]
    return files.select("repo_id").distinct().join(found, "repo_id", "left").fillna(0, zero)


def history_content(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and contents of ``repo_id, commit, path, text``: a file that many commits leave as it is is one content.

    ``repo_id, commit, path, blob`` and ``path, blob, text``; a content is its SHA-256. Callers that hold history by
    content already pass such tables themselves.
    """
    named = history.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))
    return named.select("repo_id", "commit", "path", "blob"), named.groupBy("path", "blob").agg(F.any_value("text").alias("text"))


def content_hits(blobs: DataFrame) -> DataFrame:
    """``path, blob, hits, line``: contents with secret material; every content is scanned once."""
    rows = blobs.select(F.col("blob").alias("repo_id"), "path", "text", F.octet_length("text").cast("long").alias("size_bytes"))
    found = file_signals(rows, AUDITS[SECRET_DOMAIN]).where("n_material > 0")
    return found.select("path", F.col("repo_id").alias("blob"), F.col("n_material").alias("hits"), F.col("at_material.line").alias("line"))


def history_exposures(commits: DataFrame, hits: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``repo_id, path, blob, hits, line, commits``: secret contents of each repository and how many commits hold them.

    With ``files`` (the working tree) only contents that are no longer there as they were.
    """
    held = commits.join(hits, ["path", "blob"]).groupBy("repo_id", "path", "blob").agg(
        F.min("hits").alias("hits"), F.min("line").alias("line"), F.countDistinct("commit").alias("commits")
    )
    if files is None:
        return held
    now = files.select("repo_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return held.join(now, ["repo_id", "path", "blob"], "left_anti")


def with_history(rows: DataFrame, history: DataFrame | None) -> DataFrame:
    """Secret hits in historical content, each content of a repository once; null (a trust gap) where no history was given."""
    if history is None:
        return rows.withColumn("n_history", F.lit(None).cast("long"))
    commits, blobs = history_content(history)
    found = history_exposures(commits, content_hits(blobs)).groupBy("repo_id").agg(F.sum("hits").alias("n"))
    past = commits.select("repo_id").distinct().join(found, "repo_id", "left")
    return rows.join(past.select("repo_id", F.coalesce("n", F.lit(0)).alias("n_history")), "repo_id", "left")


def states(rows: DataFrame, domain: str) -> DataFrame:
    """One row per repository and category."""
    audit = AUDITS[domain]
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(c).alias("category"),
                F.when(F.expr(audit.applicable), F.expr(e)).otherwise("not-applicable").alias("state"),
            )
            for i, (c, e) in enumerate(audit.states.items())
        ]
    )
    return rows.select("repo_id", F.lit(domain).alias("domain"), F.explode(pairs).alias("s")).select(
        "repo_id", "domain", "s.*"
    )


def weak_findings(rows: DataFrame, domain: str) -> DataFrame:
    """Findings for weak categories, located at the rule's first hit when there is one."""
    audit = AUDITS[domain]

    def one(w) -> Column:
        state = F.expr(audit.states[w.category])
        at = F.col(f"at_{w.at}") if w.at else None
        severity = P.lookup(state, w.severity)
        confidence = P.lookup(state, w.severity) if w.confidence == "by-state" else F.lit(w.confidence)
        line = F.coalesce(at["line"], F.lit(1)) if at is not None else F.lit(1)
        where = F.coalesce(at["path"], F.lit(".")) if at is not None else F.lit(".")
        text = F.coalesce(at["text"], F.lit(w.evidence)) if at is not None else F.lit(w.evidence)
        body = finding(w.category, severity, confidence, w.title, line, F.array(text), scope=where)
        return F.when(F.expr(audit.applicable) & severity.isNotNull(), body)

    found = per_repo(rows, *[one(w) for w in audit.weak])
    return found.withColumn("path", F.col("scope")).withColumn("domain", F.lit(domain))


def verdicts(state_rows: DataFrame) -> DataFrame:
    """Verdict per repository and domain from its category states."""
    has = lambda *v: F.bool_or(F.col("state").isin(*v))
    agg = state_rows.groupBy("repo_id", "domain").agg(
        F.bool_and(F.col("state") == "not-applicable").alias("none"),
        has("blocked").alias("blocked"),
        has("watch").alias("watch"),
        has("missing", "partial").alias("weak"),
        has("enforced").alias("enforced"),
    )
    watch = F.when(F.col("watch"), "watch").otherwise("clean")
    standard = F.when(F.col("weak"), "partial").when(F.col("enforced"), "enforced").otherwise("hardened")
    by_watch = [d for d, a in AUDITS.items() if a.verdict == "watch"]
    return agg.select(
        "repo_id",
        "domain",
        F.when(F.col("none"), "not-applicable")
        .when(F.col("blocked"), "scan-blocked")
        .otherwise(F.when(F.col("domain").isin(by_watch), watch).otherwise(standard))
        .alias("verdict"),
    )


def collect_matches(files: DataFrame, rules: list[LineRule], limit: int | None = None) -> DataFrame:
    """``path:line`` rows for user-given rules; an optional report limit per repository and rule."""
    src = select_surface(files, "text").withColumn("low", fold(F.col("text")))
    hits = src.withColumn("lines", line_array(F.col("text")))

    def located(rule: LineRule) -> Column:
        return F.transform(
            rule_hits(rule),
            lambda n: F.struct(
                F.lit(rule.id).alias("rule"), n.alias("line_no"), line_at(F.col("lines"), n).alias("line")
            ),
        )

    per_rule = F.flatten(F.array(*[located(r) for r in rules]))
    out = hits.select("repo_id", "path", F.explode(per_rule).alias("m")).select(
        "repo_id", "path", "m.rule", "m.line_no", snippet(F.col("m.line")).alias("text")
    )
    if limit is None:
        return out
    w = Window.partitionBy("repo_id", "rule").orderBy("path", "line_no")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def first_match_location(files: DataFrame, rules: list[LineRule]) -> DataFrame:
    """First hit per repository and rule in (path, line) order."""
    hit = F.struct("path", "line_no", "text")
    return (
        collect_matches(files, rules)
        .groupBy("repo_id", "rule")
        .agg(F.min(hit).alias("h"))
        .select("repo_id", "rule", "h.*")
    )


def audit(files: DataFrame, domain: str, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, findings and verdicts of one category audit."""
    rows = counters(files, domain)
    if domain == SECRET_DOMAIN:
        rows = with_history(rows, history)
    st = states(rows, domain)
    return st, union_findings(weak_findings(rows, domain)), verdicts(st)
