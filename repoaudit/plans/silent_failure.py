"""Silent failure: swallowed errors, escape hatches and softened contracts in Python and JavaScript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import jvm, matches
from repoaudit.functions.text import line_array, line_at, snippet
from repoaudit.operators.facts import MARK, is_js_comment, js_code, js_comments, js_pieces, match_lines, python_facts
from repoaudit.operators.findings import finding, per_file_lists, severity_counts, union_findings
from repoaudit.schemas import FINDING
from repoaudit.session import stage
from repoaudit.sources.corpus import select_surface


# fixed values: pattern, category, severity, confidence, title, gate
JS_RULES = [
    (r"(?s)catch\s*(?:\([^)]*\))?\s*\{\s*\}", "exception-swallow", "high", "high", "Empty catch block swallows the error", "block-now"),
    (r"(?s)\.catch\s*\(\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)?\s*=>\s*\{\s*\}\s*\)", "exception-swallow", "high", "high", "Promise catch handler is empty", "block-now"),
    (r"(?s)\.catch\s*\(\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)?\s*=>\s*(?:undefined|null|void\s+0)\s*\)", "exception-swallow", "high", "high", "Promise catch converts rejection into silent default", "block-now"),
    (r"\.catch\s*;", "exception-swallow", "high", "high", "`.catch;` pretends to handle rejection without doing it", "block-now"),
    (r"\bas\s+any\b", "type-escape-hatch", "high", "high", "`as any` erases type feedback", "block-changed-files"),
    (r"\bas\s+unknown\s+as\b", "type-escape-hatch", "high", "high", "Double assertion (`as unknown as`) bypasses real narrowing", "block-changed-files"),
    (r"\?\.[^\n;]*!", "unsafe-optional-chain", "high", "high", "Optional chain is followed by a non-null assertion", "block-changed-files"),
    (r"(?s)catch\s*\([^)]*\)\s*\{\s*throw\b", "useless-catch-theater", "low", "medium", "Catch block looks like theater rather than handling", "warn-only"),
]
TYPE_IGNORE = r"#\s*type:\s*ignore\b|#\s*pyright:\s*ignore\b"
NOQA = r"(?i:#\s*noqa\b)"
TS_COMMENT = r"@ts-(?:ignore|expect-error|nocheck)\b"
NON_NULL = r"(?<![=!])\b[A-Za-z_$][\w$.\])]*!\s*(?:[.\[);,:?]|$)"
DEFAULT_TAIL = r"""\s*(?:['"`].*?['"`]|[0-9]+|\[\]|\{\}|true|false|null|undefined)"""
TRUTHY_DEFAULT = r"(?:=|return)\s+[^;\n]*\|\|" + DEFAULT_TAIL
NULLISH_DEFAULT = r"(?:=|return)\s+[^;\n]*\?\?" + DEFAULT_TAIL


def py(category, severity, confidence, title, line, src, gate) -> Column:
    return finding(category, severity, confidence, title, line, F.array(src), language="python", merge_gate=gate)


def none() -> Column:
    return F.lit(None).cast(FINDING)


def handler_findings(h: Column) -> Column:
    """First rule that fits a broad handler, and separately a lost cause."""
    bare = h["bare"]
    up = lambda hard, soft: F.when(bare, hard).otherwise(soft)
    gate = up("block-changed-files", "warn-only")
    swallowed = (
        F.when(h["passes"], py("exception-swallow", up("critical", "high"), "high", "Broad except with pass swallows the failure", h["line"], h["src"], "block-now"))
        .when(h["continues"], py("skip-on-error", up("critical", "high"), "high", "Broad except continues the loop after failure", h["line"], h["src"], "block-now"))
        .when(h["returns_default"], py("silent-default", up("high", "medium"), "medium", "Broad except returns a default instead of surfacing the error", h["line"], h["src"], gate))
        .otherwise(py("exception-swallow", up("high", "medium"), "medium", "Broad except widens the failure channel", h["line"], h["src"], gate))
    )
    lost = py("cause-chain-loss", "medium", "high", "New exception is raised in except without `from e`", h["line"], h["src"], "block-changed-files")
    return F.array(F.when(h["broad"], swallowed).otherwise(none()), F.when(h["loses_cause"], lost).otherwise(none()))


def call_findings(boundary: Column):
    def rules(x: Column) -> Column:
        name, at, src = x["name"], x["line"], x["src"]
        broad = x["broad_args"]
        two = x["args"] >= 2
        return F.array(
            F.when(
                name.isin("contextlib.suppress", "suppress"),
                py("exception-swallow", F.when(broad, "high").otherwise("medium"), F.when(broad, "high").otherwise("medium"), "contextlib.suppress hides exceptions", at, src, F.when(broad, "block-changed-files").otherwise("warn-only")),
            ).otherwise(none()),
            F.when(
                name.isin("typing.cast", "cast"),
                py("type-escape-hatch", "medium", "high", "typing.cast bypasses checker scrutiny", at, src, "block-changed-files"),
            ).otherwise(none()),
            F.when(
                (name.endswith("create_task") | name.endswith("ensure_future")) & x["dropped"],
                py("async-exception-leak", "high", "high", "Fire-and-forget async task is launched without observation", at, src, "block-changed-files"),
            ).otherwise(none()),
            F.when(
                x["text_key"] & (two | ~boundary),
                py("silent-default", F.when(two, "medium").otherwise("low"), "low", "dict.get style fallback may soften a required key", at, src, F.when(two, "warn-only").otherwise("unverified")),
            ).otherwise(none()),
            F.when(
                (name == "getattr") & (x["args"] >= 3),
                py("optionality-leak", "low", "low", "getattr fallback may hide a model contract break", at, src, "unverified"),
            ).otherwise(none()),
            F.when(
                name == "hasattr",
                py("optionality-leak", "low", "low", "hasattr may be widening a contract into maybe-logic", at, src, "unverified"),
            ).otherwise(none()),
        )

    return rules


def detect_python(facts: DataFrame) -> DataFrame:
    """Python findings from fact rows."""
    boundary = P.is_boundary(F.col("path"))
    flat = lambda field, rule: F.flatten(F.transform(field, rule))
    comments = F.transform(
        "comments",
        lambda c: F.when(
            matches(c["text"], TYPE_IGNORE),
            py("type-escape-hatch", "high", "high", "Type ignore suppresses checker feedback", c["line"], c["src"], "block-changed-files"),
        )
        .when(
            matches(c["text"], NOQA),
            py("lint-escape-hatch", "medium", "high", "noqa suppresses linter feedback", c["line"], c["src"], "block-changed-files"),
        )
        .otherwise(none()),
    )
    optional = F.transform(
        "optionals",
        lambda o: py("optionality-leak", "low", "low", "Nullable type appears in a non-boundary path", o["line"], o["src"], "unverified"),
    )
    empty = F.array().cast(f"array<{FINDING.simpleString()}>")
    fallback = F.transform(
        "fallbacks",
        lambda o: py("truthiness-fallback", "medium", "low", "Truthiness fallback may overwrite legitimate falsy values", o["line"], o["src"], "warn-only"),
    )
    return per_file_lists(
        facts,
        comments,
        F.when(~boundary, optional).otherwise(empty),
        flat("handlers", handler_findings),
        flat("calls", call_findings(boundary)),
        fallback,
    )


def js_view(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript files with blanked code and comment rows; no Python workers involved."""
    path = F.col("path")
    return (
        files.where(P.suffix(path).isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"))
        .select("repo_id", "path", "text", js_pieces(F.col("text")).alias("pieces"))
        .select(
            "repo_id",
            "path",
            F.when(P.suffix(path).isin(".ts", ".tsx"), "typescript").otherwise("javascript").alias("language"),
            js_code(F.col("pieces")).alias("code"),
            line_array(F.col("text")).alias("lines"),
            F.when(F.exists("pieces", is_js_comment), js_comments(F.col("pieces")))
            .otherwise(F.array().cast("array<struct<line:int,text:string>>"))
            .alias("comments"),
        )
        .withColumn("code_lines", line_array(F.col("code")))
    )


def detect_js(files: DataFrame) -> DataFrame:
    lines, code, language = F.col("lines"), F.col("code"), F.col("language")
    raw = lambda n: snippet(line_at(lines, n))

    def js(category, severity, confidence, title, line, gate) -> Column:
        return finding(category, severity, confidence, title, line, F.array(raw(line)), language=language, merge_gate=gate)

    def patterned(rule) -> Column:
        pattern, category, severity, confidence, title, gate = rule
        literal = ".catch" if pattern.startswith((r"\.catch", r"(?s)\.catch")) else None
        found = F.transform(match_lines(code, pattern), lambda n: js(category, severity, confidence, title, n, gate))
        if literal is None:
            return found
        return F.when(code.contains(literal), found).otherwise(F.array().cast(f"array<{FINDING.simpleString()}>"))

    comments = F.flatten(
        F.transform(
            "comments",
            lambda c: F.array(
                F.when(matches(c["text"], TS_COMMENT), js("type-escape-hatch", "high", "high", "ts-comment suppression hides a type problem", c["line"], "block-changed-files")).otherwise(none()),
                F.when(c["text"].contains("eslint-disable"), js("lint-escape-hatch", "medium", "high", "eslint-disable suppresses rule feedback", c["line"], "block-changed-files")).otherwise(none()),
            ),
        )
    )
    # every match counts, also several on one line
    marked = F.split(F.regexp_replace(F.translate(code, MARK, " "), jvm(f"({NON_NULL})"), f"{MARK}$1"), "\n", -1)
    spots = F.flatten(
        F.transform(marked, lambda s, i: F.array_repeat(i + 1, F.length(s) - F.length(F.replace(s, F.lit(MARK), F.lit("")))))
    )
    non_null = F.transform(
        F.filter(spots, lambda n: ~raw(n).contains("!=")),
        lambda n: js("type-escape-hatch", "medium", "medium", "Non-null assertion removes a nullish safety check at compile time", n, "warn-only"),
    )
    chained = F.filter(
        F.transform("code_lines", lambda s, i: F.when(F.regexp_count(s, F.lit(r"\?\.")) >= 2, i + 1)), lambda n: n.isNotNull()
    )
    chains = F.transform(
        chained,
        lambda n: js("optionality-leak", "low", "low", "Optional chaining is stacked on a core access path", n, "unverified"),
    )
    defaults = F.flatten(
        F.transform(
            "code_lines",
            lambda s, i: F.array(
                F.when(s.contains("||") & s.rlike(TRUTHY_DEFAULT), F.struct((i + 1).alias("n"), F.lit(True).alias("truthy"))),
                F.when(s.contains("??") & s.rlike(NULLISH_DEFAULT), F.struct((i + 1).alias("n"), F.lit(False).alias("truthy"))),
            ),
        )
    )
    softened = F.transform(
        F.filter(defaults, lambda d: d.isNotNull()),
        lambda d: F.when(d["truthy"], js("truthiness-fallback", "medium", "low", "`||` fallback may overwrite legitimate falsy values", d["n"], "warn-only")).otherwise(
            js("silent-default", "low", "low", "Nullish fallback may be softening a required contract", d["n"], "unverified")
        ),
    )
    return per_file_lists(js_view(files), *[patterned(r) for r in JS_RULES], comments, non_null, chains, softened)


def scan_blockers(facts: DataFrame) -> DataFrame:
    return facts.where("parse_error is not null").select("repo_id", "path", F.col("error_line").alias("line"), "parse_error")


def verdict_rows(files: DataFrame, found: DataFrame) -> DataFrame:
    src = select_surface(files, "silent-failure").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_scanned"))
    c = F.col("category")
    kinds = found.groupBy("repo_id").agg(
        F.bool_or(c.isin("exception-swallow", "skip-on-error", "async-exception-leak")).alias("risk"),
        F.bool_or(
            c.isin(
                "type-escape-hatch", "lint-escape-hatch", "silent-default", "truthiness-fallback", "optionality-leak",
                "unsafe-optional-chain",
            )
        ).alias("soft"),
    )
    rows = (
        files.select("repo_id").distinct().join(src, "repo_id", "left").join(severity_counts(found), "repo_id", "left")
        .join(kinds, "repo_id", "left").fillna(0).fillna(False)
    )
    return rows.withColumn(
        "verdict",
        F.when(F.col("files_scanned") == 0, "not-applicable")
        .when((F.col("critical") > 0) | F.col("risk"), "silent-failure-risk")
        .when(F.col("soft"), "contract-softened")
        .otherwise("fail-loud"),
    )


def audit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    src = select_surface(files, "silent-failure")
    facts = stage(python_facts(src), "python-facts")
    found = union_findings(detect_python(facts), detect_js(src))
    return found, verdict_rows(files, found)
