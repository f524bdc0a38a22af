"""Error contract audit: file hits, repository counters, gaps, gates and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import Bank, fold, has_any, matches
from repoaudit.functions.text import first_match_line, line_array, line_at, snippet
from repoaudit.operators.findings import expand, finding, per_repo, severity_counts, union_findings
from repoaudit.rules import error_contract as R
from repoaudit.session import stage
from repoaudit.sources.corpus import repositories, select_surface

ALL_CATEGORIES = list(R.FILE_FINDINGS) + list(R.REPO_FINDINGS)


def file_signals(files: DataFrame) -> DataFrame:
    """One pass over texts: surface flags, field flags and first-line findings per file."""
    src = select_surface(files, "error-governance").where(F.col("text") != "").withColumn("low", fold(F.col("text")))
    text, path, low = F.col("text"), F.col("path"), F.col("low")
    sfx = P.suffix(path)
    lower_path = F.lower(path)
    code_file = sfx.isin(R.CODE_SUFFIXES)
    structured = sfx.isin(R.STRUCTURED_SUFFIXES)
    product_code = (
        code_file & ~F.concat(F.lit("/"), lower_path).contains("/tests/") & ~P.name(lower_path).contains("test_")
    )
    in_ci = lower_path.contains(".github/workflows/") | lower_path.rlike(r"pre-commit-config\.ya?ml$")
    lines = line_array(text)

    def hit(category: str, rules: Bank, when: Column) -> Column:
        severity, confidence, title, decision, gate = R.FILE_FINDINGS[category]
        at = first_match_line(lines, rules)
        body = finding(
            category, severity, confidence, title, at, F.array(snippet(line_at(lines, at))), scope=path,
            decision=decision, merge_gate=gate,
        )
        # a line hit implies a hit in the text, so lines are only cut where the bank occurs at all
        return F.when(when & has_any(text, rules, low) & at.isNotNull(), body)

    surfaces = {
        "n_openapi": matches(path, R.OPENAPI) | (structured & matches(text, R.OPENAPI, low)),
        "n_asyncapi": matches(path, R.ASYNCAPI) | (structured & matches(text, R.ASYNCAPI, low)),
        "n_catalog": matches(path, R.PATHS["catalog"]),
        "n_generated": matches(path, R.PATHS["generated"]) & has_any(text, R.CODEGEN_HINT, low),
        "n_handler": code_file & matches(path, R.PATHS["handler"]),
        "n_doc_claims": sfx.isin(R.DOC_SUFFIXES) & has_any(text, R.DOC_CLAIM, low),
    }
    schema_like = matches(path, R.PATHS["schema"]) | matches(text, R.PROBLEM_DETAILS, low)
    relevant = schema_like
    for k in ("n_openapi", "n_asyncapi", "n_catalog", "n_generated", "n_handler"):
        relevant = relevant | surfaces[k]
    return src.select(
        "repo_id",
        "path",
        *[c.alias(k) for k, c in surfaces.items()],
        relevant.alias("n_relevant"),
        *[matches(text, p, low).alias(f"core_{k}") for k, p in R.CORE_FIELDS.items()],
        *[matches(text, p, low).alias(f"ext_{k}") for k, p in R.EXTENSION_FIELDS.items()],
        *[matches(text, p, low).alias(f"fw_{k}") for k, p in R.FRAMEWORKS.items()],
        matches(text, R.PROBLEM_MEDIA, low).alias("problem_media"),
        has_any(text, R.ASYNC_STRUCTURED, low).alias("async_structured"),
        has_any(text, R.GLOBAL_HANDLER, low).alias("global_handler"),
        (in_ci & has_any(text, R.CI_GUARD, low)).alias("ci_guard"),
        (P.application_language(path) == "python").alias("l_python"),
        (P.application_language(path) == "typescript").alias("l_typescript"),
        (P.application_language(path) == "javascript").alias("l_javascript"),
        F.array_compact(
            F.array(
                hit("text-branching", R.TEXT_BRANCH, product_code),
                hit("leakage-risk", R.LEAKAGE, product_code & has_any(text, R.OUTWARD, low)),
                hit("numeric-or-vague-code", R.NUMERIC_CODE, product_code),
            )
        ).alias("found"),
    )


def counters(signals: DataFrame, repos: DataFrame) -> DataFrame:
    """Files with each surface or field, and repository-wide flags. All combine map-side.

    ``repos`` has one row per repository; one without files of the surface keeps its row, with nothing counted.
    """
    names = signals.columns
    counted = [c for c in names if c.startswith(("n_", "core_", "ext_"))]
    flags = [c for c in names if c.startswith(("l_", "fw_"))] + [
        "problem_media", "async_structured", "global_handler", "ci_guard",
    ]
    found = signals.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        *[F.count_if(c).alias(c) for c in counted],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags],
    )
    return repos.join(found, "repo_id", "left").fillna(0).fillna(False)


def repo_findings(rows: DataFrame) -> DataFrame:
    def one(category: str) -> Column:
        severity, confidence, scope, title, evidence, decision, gate = R.REPO_FINDINGS[category]
        values = [F.lit(severity), F.lit(title), F.lit(evidence), F.lit(gate)]
        if category == "ssot-missing":
            high = F.expr(R.SSOT_IS_HIGH)
            values = [F.when(high, v).otherwise(F.lit(soft)) for v, soft in zip(values, R.SSOT_SOFT)]
        body = finding(
            category, values[0], confidence, values[1], 1, F.array(values[2]), scope=scope, decision=decision,
            merge_gate=values[3],
        )
        return F.when(F.expr(R.CONDITIONS[category]), body)

    return per_repo(rows, *[one(c) for c in R.REPO_FINDINGS])


def verdict_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counters, severity counts and category flags side by side; gates and verdict on top."""
    present = found.groupBy("repo_id").agg(
        *[
            F.coalesce(F.bool_or(F.col("category") == c), F.lit(False)).alias(c.replace("-", "_"))
            for c in ALL_CATEGORIES
        ]
    )
    joined = rows.join(severity_counts(found), "repo_id", "left").join(present, "repo_id", "left")
    return joined.fillna(0).fillna(False).select(
        "*", F.expr(R.VERDICT).alias("verdict"), *[F.expr(e).alias(f"gate_{k.replace('-', '_')}") for k, e in R.GATES.items()]
    )


def gate_states(verdicts: DataFrame) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(g).alias("gate"), F.col(f"gate_{g.replace('-', '_')}").alias("state")) for g in R.GATES]
    )
    return verdicts.select("repo_id", F.explode(pairs).alias("g")).select("repo_id", "g.*")


def profile(rows: DataFrame) -> DataFrame:
    """Sorted languages, frameworks and protocols per repository."""
    pick = lambda items: F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in items]))
    return rows.select(
        "repo_id",
        pick([(k, F.col(f"l_{k}")) for k in ("javascript", "python", "typescript")]).alias("languages"),
        pick([(k, F.col(f"fw_{k}")) for k in sorted(R.FRAMEWORKS)]).alias("frameworks"),
        pick(
            [("async", F.col("n_asyncapi") > 0), ("http", (F.col("n_openapi") > 0) | (F.col("n_handler") > 0))]
        ).alias("protocols"),
    )


def audit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and verdict rows; file texts are read once."""
    signals = stage(file_signals(files), "error-contract")
    rows = counters(signals, repositories(files))
    found = union_findings(expand(signals, F.col("found")), repo_findings(rows))
    return found, verdict_rows(rows, found)
