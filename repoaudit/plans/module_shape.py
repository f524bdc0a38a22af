"""Module shape: file and function metrics, thresholds, duplication, composite hotspots, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.text import line_array, nloc
from repoaudit.operators.facts import python_facts, rows_of, ts_export_count, ts_function_rows, ts_imports
from repoaudit.operators.findings import (
    cap, demote, digest_id, finding, per_file, severity_rank, union_findings,
)
from repoaudit.operators.windows import duplicate_stats, shingles
from repoaudit.rules import module_shape as R
from repoaudit.session import stage
from repoaudit.sources.corpus import select_surface

FILE_KEY = ["repo_id", "path"]


def language(path: Column) -> Column:
    return F.when(P.suffix(path) == ".py", "python").otherwise("typescript")


def function_rows(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Functions of both languages with span, size, branch complexity and parameter count."""
    cols = ["repo_id", "path", "name", "line", "end_line", "nloc", "complexity", "params"]
    return rows_of(facts, "functions").select(*cols).unionByName(ts_function_rows(files).select(*cols))


def top_imports(imports: Column) -> Column:
    """Module names of top-level imports; a bare relative import is named by its dots."""
    top = F.filter(imports, lambda i: i["top"])
    return F.transform(top, lambda i: F.when(i["module"] != "", i["module"]).otherwise(F.repeat(F.lit("."), i["level"])))


def file_metrics(files: DataFrame, facts: DataFrame, functions: DataFrame) -> DataFrame:
    """One narrow row per source file. All joins are on the file key and carry no text."""
    src = select_surface(files, "module-shape")
    path, text = F.col("path"), F.col("text")
    lang = language(path)
    is_ts = lang == "typescript"
    base = src.select(
        "repo_id",
        "path",
        lang.alias("language"),
        F.size(line_array(text)).alias("total_lines"),
        nloc(text, lang).alias("code_lines"),
        P.is_test(path).alias("test_like"),
        P.is_generated(path).alias("generated_like"),
        P.is_migration(path).alias("migration_like"),
        P.name(path).isin("__init__.py", "index.ts", "index.tsx").alias("barrel_like"),
        F.when(is_ts, ts_imports(text)).alias("ts_imports"),
        F.when(is_ts, ts_export_count(text)).alias("ts_exports"),
    )
    py = facts.select(
        *FILE_KEY, "parse_error", "error_line", F.col("exports").alias("py_exports"), top_imports(F.col("imports")).alias("py_imports")
    )
    sizes = functions.groupBy(*FILE_KEY).agg(
        F.max("nloc").alias("max_function_nloc"),
        F.max("complexity").alias("max_function_complexity"),
        F.count(F.lit(1)).alias("n_functions"),
    )
    dup = duplicate_stats(
        shingles(src.where(~P.is_generated(path) & ~P.is_migration(path)), lang)
    )
    joined = base.join(py, FILE_KEY, "left").join(sizes, FILE_KEY, "left").join(dup, FILE_KEY, "left")
    imports = F.coalesce("ts_imports", "py_imports", P.strings([]))
    clean = F.col("parse_error").isNull()
    return joined.select(
        *FILE_KEY,
        "language", "total_lines", "code_lines", "test_like", "generated_like", "migration_like", "barrel_like",
        "parse_error", "error_line",
        F.size(F.array_distinct(imports)).alias("fan_out"),
        F.coalesce("ts_exports", "py_exports", F.lit(0)).alias("exports"),
        F.when(clean, P.responsibility_tags(imports, path)).otherwise(P.strings([])).alias("tags"),
        *[
            F.coalesce(c, F.lit(0)).cast("int").alias(c)
            for c in ("max_function_nloc", "max_function_complexity", "n_functions", "duplicate_windows", "duplicate_partners")
        ],
    )


def level(value: Column, limits: tuple) -> Column:
    """Severity of a number against (warn, block[, critical]); null below the first."""
    out = F.lit(None).cast("string")
    if len(limits) == 3:
        return F.when(value >= limits[2], "critical").when(value >= limits[1], "high").when(value >= limits[0], "medium").otherwise(out)
    return F.when(value >= limits[1], "high").when(value >= limits[0], "medium").otherwise(out)


def merge_gate(severity: Column, extreme: Column | bool = False) -> Column:
    hard = F.lit(extreme) if isinstance(extreme, bool) else extreme
    return F.when(hard | (severity == "critical"), "block-now").when(severity == "high", "block-changed-files").otherwise("warn-only")


def detect_files(metrics: DataFrame) -> DataFrame:
    """File findings. A composite hotspot replaces the single findings of its file."""
    c = F.col
    test = c("test_like")
    n = F.size("tags")
    mixed = (
        F.when((n >= 4) & (c("code_lines") >= 200), F.when(c("code_lines") >= R.FILE_NLOC[1], "high").otherwise("medium"))
        .when((n >= 3) & (c("code_lines") >= 180), "medium")
        .when((n >= 2) & (c("fan_out") >= R.FAN_OUT[0]) & (c("code_lines") >= 250), "medium")
    )
    barrel = c("barrel_like") & (c("code_lines") < 150) & (c("n_functions") == 0)
    signals = {
        "oversized-file": demote(level(c("code_lines"), R.FILE_NLOC), test),
        "hub-module": demote(level(c("fan_out"), R.FAN_OUT), test),
        "export-surface-sprawl": demote(F.when(~barrel, level(c("exports"), R.EXPORTS)), test),
        "mixed-responsibility": demote(mixed, test),
        "duplication-cluster": demote(level(c("duplicate_windows"), R.DUPLICATE_WINDOWS), test),
        "function-pressure": level(F.greatest("max_function_nloc", "max_function_complexity"), R.FUNCTION_NLOC),
    }
    rows = metrics.withColumns({f"s_{k}": v for k, v in signals.items()})
    sig = {k: c(f"s_{k}") for k in signals}
    composite = sum((v.isNotNull().cast("int") for v in sig.values()), F.lit(0))
    extreme = (c("code_lines") >= R.FILE_NLOC[2]) | (composite >= 4)
    god = (composite >= 3) & (c("code_lines") >= R.FILE_NLOC[0])
    live = ~c("generated_like") & ~c("migration_like")
    num = lambda name: c(name).cast("string")
    tags = F.array_join("tags", ", ")
    god_severity = F.when(extreme, "critical").otherwise("high")

    def single(category: str, confidence: str, decision: str, evidence: Column, hard: Column | bool = False) -> Column:
        s = sig[category]
        return F.when(
            live & ~god & s.isNotNull(),
            finding(
                category, s, confidence, R.TITLES[category], 1, F.array(evidence), merge_gate=merge_gate(s, hard),
                decision=decision,
            ),
        )

    return per_file(
        rows,
        F.when(
            c("parse_error").isNotNull(),
            finding(
                "scan-blocker", "low", "high", R.TITLES["scan-blocker"], 1,
                F.array(F.concat(F.lit("python parse error: "), c("parse_error"), F.lit(" (line "), num("error_line"), F.lit(")"))),
                merge_gate="unverified", decision="fix-scan",
            ),
        ),
        F.when(
            live & god,
            finding(
                "god-module", god_severity, "high", R.TITLES["god-module"], 1,
                F.array(
                    F.concat(
                        num("code_lines"), F.lit(" code lines, fan-out "), num("fan_out"), F.lit(", exports "), num("exports"),
                        F.lit(", responsibilities "), F.when(tags == "", "n/a").otherwise(tags),
                        F.lit(", duplicate windows "), num("duplicate_windows"), F.lit(", max function "),
                        num("max_function_nloc"), F.lit(" lines."),
                    )
                ),
                merge_gate=merge_gate(god_severity, extreme), decision="split",
            ),
        ),
        single("oversized-file", "high", "split", F.concat(num("code_lines"), F.lit(" code lines in one file.")), c("code_lines") >= R.FILE_NLOC[2]),
        single("hub-module", "high", "narrow", F.concat(F.lit("Imports "), num("fan_out"), F.lit(" unique modules.")), c("fan_out") >= R.FAN_OUT[2]),
        single("export-surface-sprawl", "high", "narrow", F.concat(F.lit("Exports "), num("exports"), F.lit(" public symbols.")), c("exports") >= R.EXPORTS[2]),
        single("mixed-responsibility", "medium", "separate", F.concat(F.lit("Responsibility tags: "), tags, F.lit("."))),
        single(
            "duplication-cluster", "medium", "deduplicate",
            F.concat(num("duplicate_windows"), F.lit(" duplicate windows across "), num("duplicate_partners"), F.lit(" partner files.")),
        ),
    )


def function_level(row_nloc: Column, complexity: Column) -> Column:
    def over(i: int) -> Column:
        return (row_nloc >= R.FUNCTION_NLOC[i]) | (complexity >= R.COMPLEXITY[i])

    return F.when(over(2), "critical").when(over(1), "high").when(over(0), "medium")


def long_function_rows(functions: DataFrame) -> DataFrame:
    """Functions over a threshold, outside generated and migration trees."""
    path = F.col("path")
    raw = function_level(F.col("nloc"), F.col("complexity"))
    return functions.where(~P.is_generated(path) & ~P.is_migration(path)).withColumn("raw", raw).where("raw is not null")


def function_findings(rows: DataFrame) -> DataFrame:
    severity = demote(F.col("raw"), P.is_test(F.col("path")))
    extreme = (F.col("nloc") >= R.FUNCTION_NLOC[2]) | (F.col("complexity") >= R.COMPLEXITY[2])
    text = F.concat(
        F.col("nloc").cast("string"), F.lit(" code lines, approx complexity "), F.col("complexity").cast("string"),
        F.lit(", "), F.col("params").cast("string"), F.lit(" parameters."),
    )
    body = finding(
        "long-function", severity, "high",
        F.concat(F.lit("Function '"), F.col("name"), F.lit("' is too large or too branch-heavy")), F.col("line"),
        F.array(text), merge_gate=merge_gate(severity, extreme), decision="extract",
    )
    return rows.select("repo_id", "path", F.col("line").alias("emit_ord"), body.alias("f")).select(
        "repo_id", "path", "emit_ord", "f.*"
    )


def detect_functions(functions: DataFrame) -> DataFrame:
    """A finding for every long or branch-heavy function."""
    return function_findings(long_function_rows(functions))


def longest_functions(functions: DataFrame, n: int = R.LONG_FUNCTIONS_SHOWN) -> DataFrame:
    """Report: the worst ``n`` functions of each repository, ranked before findings are built."""
    order = [severity_rank("raw"), F.desc("nloc"), F.desc("complexity"), F.col("path"), F.col("line")]
    return function_findings(cap(long_function_rows(functions), ["repo_id"], order, n))


def with_ids(found: DataFrame) -> DataFrame:
    name = F.regexp_extract("title", r"^Function '(.*)' is too", 1)
    extra = F.when(F.col("category") == "long-function", name).otherwise("")
    kind = F.when(F.col("category") == "export-surface-sprawl", "export-surface").otherwise(F.col("category"))
    return found.withColumn("id", digest_id("msh", kind, F.col("path"), extra))


def verdict_rows(metrics: DataFrame, found: DataFrame, repos: DataFrame) -> DataFrame:
    """Verdict per repository; parse blockers outside exempt trees stop the verdict."""
    live = ~F.col("generated_like") & ~F.col("migration_like")
    files = metrics.groupBy("repo_id").agg(
        F.count_if(live).alias("meaningful"),
        F.count_if(live & F.col("parse_error").isNotNull()).alias("blocked"),
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("language") == "python").alias("python_files"),
        F.count_if(F.col("language") == "typescript").alias("typescript_files"),
        F.count_if(~live).alias("exempt_files"),
    )
    real = found.where(F.col("category") != "scan-blocker")
    counts = real.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
        F.min_by("path", F.struct(severity_rank(), F.col("path"))).alias("worst_file"),
    )
    rows = repos.select("repo_id").distinct().join(files, "repo_id", "left").join(counts, "repo_id", "left").fillna(0)
    return rows.withColumn(
        "verdict",
        F.when(F.col("meaningful") == 0, "not-applicable")
        .when(F.col("blocked") > 0, "scan-blocked")
        .when(F.col("critical") > 0, "split-before-merge")
        .when(F.col("high") >= 2, "sprawling")
        .when((F.col("high") >= 1) | (F.col("medium") >= 3), "contained")
        .otherwise("disciplined"),
    )


def audit(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, findings and verdicts. Sources are parsed once."""
    src = select_surface(files, "module-shape")
    facts = stage(python_facts(src), "python-facts")
    functions = stage(function_rows(src, facts), "functions")
    metrics = stage(file_metrics(files, facts, functions), "file-metrics")
    found = union_findings(detect_files(metrics), detect_functions(functions))
    return metrics, found, verdict_rows(metrics, found, files)


