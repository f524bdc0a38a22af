"""Contract gates: per-file signals, repository signals, gate states, ranked findings, verdict."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.text import count_literals
from repoaudit.operators.findings import finding
from repoaudit.rules import contract_gates as R
from repoaudit.sources.corpus import select_surface

FLAGS = ["python_strict", "typed_lint", "ts_strict", "runtime_schema", "error_contract", "architecture_config", "contract_tests"]


def any_word(col: Column, words: list[str]) -> Column:
    return reduce(or_, [col.contains(w) for w in words])


def file_signals(files: DataFrame) -> DataFrame:
    """Literal searches over the lower-case text; nothing wider than flags leaves this pass."""
    src = select_surface(files, "contracts").withColumn("low", F.lower("text"))
    path, low = F.col("path"), F.col("low")
    name = P.name(path)
    has = low.contains
    is_project, is_package = name == "pyproject.toml", name == "package.json"
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)\z", 1)
    pyproject_noqa = is_project & has("[tool.ruff]") & (has("per-file-ignores") | has("ignore ="))
    surface_name = any_word(F.lower(name), R.SURFACE_NAMES)
    return src.select(
        "repo_id",
        "path",
        (surface_name | any_word(low, R.SURFACE_WORDS)).alias("surface"),
        (surface_name | any_word(low, R.SCHEMA_WORDS)).alias("schema_source"),
        (
            is_project
            & (
                (has("[tool.basedpyright]") & has("strict = true"))
                | (has("[tool.pyright]") & (has('typecheckingmode = "strict"') | has("strict = true")))
            )
        ).alias("python_strict"),
        (
            is_package & has("@typescript-eslint") & any_word(low, ["projectservice", "recommendedtypechecked", "parseroptions"])
        ).alias("typed_lint"),
        ((name == "tsconfig.json") & has('"strict"') & has("true")).alias("ts_strict"),
        (any_word(low, R.RUNTIME_WORDS) | (is_package & any_word(low, R.PACKAGE_RUNTIME_WORDS))).alias("runtime_schema"),
        any_word(low, R.ERROR_WORDS).alias("error_contract"),
        (
            (is_project & has("[tool.tach]")) | (is_package & (has("dependency-cruiser") | has("depcruise")))
        ).alias("architecture_config"),
        (F.array_contains(P.parts(path), "tests") & any_word(low, R.TEST_WORDS)).alias("contract_tests"),
        F.when(
            any_word(low, R.ESCAPES),
            count_literals(low, R.ESCAPES) + F.when(pyproject_noqa, count_literals(low, ["noqa"])).otherwise(0),
        )
        .otherwise(0)
        .alias("escapes"),
        suffix.isin(".py", ".pyi").alias("l_python"),
        suffix.isin(".ts", ".tsx").alias("l_typescript"),
        suffix.isin(".js", ".jsx").alias("l_javascript"),
        (is_project | is_package).alias("manifest"),
    )


def repo_signals(files: DataFrame) -> DataFrame:
    """One row per repository; workflow and ownership files are counted over all its files."""
    path = F.col("path")
    sig = file_signals(files).groupBy("repo_id").agg(
        *[F.bool_or(c).alias(c) for c in FLAGS + ["l_python", "l_typescript", "l_javascript"]],
        F.count_if("surface").alias("n_surface"),
        F.count_if("schema_source").alias("n_schema_sources"),
        F.count_if("manifest").alias("n_manifests"),
        F.sum("escapes").alias("escape_hatches"),
    )
    gov = files.groupBy("repo_id").agg(
        F.count_if(path.rlike(r"^\.github/workflows/[^/]*\.y[^/]*ml$")).alias("n_workflows"),
        F.bool_or(path.isin(R.CODEOWNERS)).alias("codeowners"),
    )
    return gov.join(sig, "repo_id", "left").fillna(0).fillna(False)


def with_tool_runs(signals: DataFrame, merged: DataFrame) -> DataFrame:
    """Signals raised by tools that ran: typed, boundary and lint tools, and reported escape hatches."""
    ran = F.col("status").isin("passed", "issues")
    up = merged.groupBy("repo_id").agg(
        F.bool_or((F.col("tool") == "basedpyright") & ran).alias("t_python"),
        F.bool_or((F.col("tool") == "tsc") & ran).alias("t_ts"),
        F.bool_or((F.col("tool") == "typescript-eslint-stack") & ran).alias("t_lint"),
        F.bool_or(F.col("tool").isin("tach", "dependency-cruiser") & ran).alias("t_arch"),
        F.sum(F.when(F.col("tool") == "semgrep", F.col("issue_count")).otherwise(0)).alias("t_escapes"),
    )
    j = signals.join(up, "repo_id", "left").fillna(0).fillna(False)
    return j.select(
        *[c for c in signals.columns if c not in ("python_strict", "ts_strict", "typed_lint", "architecture_config", "escape_hatches")],
        (F.col("python_strict") | F.col("t_python")).alias("python_strict"),
        (F.col("ts_strict") | F.col("t_ts")).alias("ts_strict"),
        (F.col("typed_lint") | F.col("t_lint")).alias("typed_lint"),
        (F.col("architecture_config") | F.col("t_arch")).alias("architecture_config"),
        (F.col("escape_hatches") + F.col("t_escapes")).alias("escape_hatches"),
    )


def gate_states(signals: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(g).alias("gate"), F.expr(e).alias("state")) for g, e in R.STATES.items()])
    key = F.concat_ws("/", "gate", "state")
    return (
        signals.select("repo_id", F.explode(pairs).alias("g"))
        .select("repo_id", "g.*")
        .withColumn("severity", P.lookup(key, {"/".join(k): v[0] for k, v in R.LEVELS.items()}))
        .withColumn("confidence", P.lookup(key, {"/".join(k): v[1] for k, v in R.LEVELS.items()}))
    )


def detect(states: DataFrame) -> DataFrame:
    """Findings of weak gates, ordered by state then gate; a report cuts them by ``rank``."""
    gate, state, severity = F.col("gate"), F.col("state"), F.col("severity")
    rank = P.lookup(state, {k: str(v) for k, v in R.STATE_PRIORITY.items()}).cast("int")
    decision = (
        F.when(gate.isin("architecture-boundaries", "compile-time-gates") & (state == "theater"), "replace")
        .when(state.isin("partial", "unverified"), "harden")
        .otherwise("adopt")
    )
    merge_gate = (
        F.when(state == "unverified", "unverified").when(severity.isin("critical", "high"), "block-now").otherwise("block-changed-files")
    )
    body = finding(
        gate, severity, F.col("confidence"), P.lookup(gate, R.TITLES), None, F.array(state), decision=decision,
        merge_gate=merge_gate, scope="repo",
    )
    # eight gates per repository at most, so this window never sees a large group
    w = Window.partitionBy("repo_id").orderBy(rank, "gate")
    return (
        states.where(~state.isin("enforced", "hardened"))
        .withColumn("rank", F.row_number().over(w))
        .withColumn("autofix", gate.isin("contract-surface", "compile-time-gates") & (state == "partial"))
        .select("repo_id", F.lit(".").alias("path"), "rank", "autofix", body.alias("f"))
        .select("repo_id", "path", "rank", "autofix", "f.*")
    )


def verdicts(states: DataFrame) -> DataFrame:
    wide = states.groupBy("repo_id").agg(
        *[F.max(F.when(F.col("gate") == g, F.col("state"))).alias(g.replace("-", "_")) for g in R.STATES],
        F.count_if(F.col("state").isin("enforced", "hardened")).alias("n_strong"),
    )
    return wide.select("repo_id", F.expr(R.VERDICT).alias("verdict"))
