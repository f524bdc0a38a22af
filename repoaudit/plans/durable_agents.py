"""Durable agents: workflow and agent surfaces, hazards, tool contracts, ten gates, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.text import hit_lines, line_array
from repoaudit.operators.facts import rows_of
from repoaudit.operators.findings import finding, severity_rank, union_findings
from repoaudit.plans.contract_gates import any_word
from repoaudit.rules import durable_agents as R
from repoaudit.sources.corpus import select_surface


def file_signals(files: DataFrame, raw_agent_word: str = "agent(") -> DataFrame:
    """Flags and counts per file. Lines are only cut in workflow files.

    The raw-agent test is case-sensitive by the rule's definition; pass ``"Agent("`` for
    the stricter reading.
    """
    src = select_surface(files, "durable-agents")
    src = src.withColumn("low", F.lower("text"))
    path, low, text = F.col("path"), F.col("low"), F.col("text")
    name = P.name(path)
    py = path.endswith(".py")
    has = low.contains
    workflow = py & (has("@workflow.defn") | has("temporalio.workflow"))
    lines = line_array(text)
    raw = F.filter(lines, lambda s: s.contains(raw_agent_word) & ~F.lower(s).contains("temporalagent("))
    contract_text = py | (name == "pyproject.toml")
    return src.select(
        "repo_id",
        "path",
        py.alias("py"),
        (py & any_word(low, R.WORKFLOW_WORDS)).alias("workflow_surface"),
        (py & any_word(low, R.AGENT_WORDS)).alias("agent_surface"),
        (
            (name.startswith("README") | name.startswith("AGENTS") | F.array_contains(P.parts(path), "docs"))
            & any_word(low, R.DOC_WORDS)
        ).alias("docs_surface"),
        *[(py & has(w)).alias(k) for k, w in R.OFFICIAL.items()],
        F.when(workflow, F.size(hit_lines(lines, R.HAZARDS))).otherwise(0).alias("hazards"),
        F.when(workflow, F.size(raw)).otherwise(0).alias("raw_agents"),
        (py & (has("sandbox_unrestricted") | has("sandboxed=false") | has("unsandboxedworkflowrunner"))).alias("escape"),
        (
            py & has("temporalagent(") & (has("openaimodel(") | has("anthropicmodel(") | has("model="))
        ).alias("raw_model"),
        (py & has("replay")).alias("replay"),
        (py & has("time_skipping")).alias("time_skipping"),
        (py & any_word(low, ["testmodel", "functionmodel", "agent.override", "allow_model_requests"])).alias("fake_model"),
        (has("asyncio.sleep") & (has("always wrong") | has("forbidden"))).alias("wrong_docs"),
        (contract_text & has("args_validator")).alias("validator"),
        (contract_text & has("modelretry")).alias("model_retry"),
        (contract_text & has("deps=")).alias("deps"),
        (contract_text & has("deps_type")).alias("deps_type"),
    )


def tool_issues(facts: DataFrame) -> DataFrame:
    """Tool functions whose first parameter disagrees with their decorator."""
    fn = rows_of(facts, "functions")
    context = F.col("first_annotation").contains("RunContext")
    message = (
        F.when(F.col("tool") & (F.col("args") == 0), "@agent.tool without arguments")
        .when(F.col("tool") & ~context, "@agent.tool first parameter is not annotated as RunContext")
        .when(F.col("tool_plain") & (F.col("args") > 0) & context, "@agent.tool_plain unexpectedly takes RunContext")
    )
    return fn.select("repo_id", "path", "line", message.alias("message")).where("message is not null")


def repo_signals(files: DataFrame, facts: DataFrame) -> DataFrame:
    sig = file_signals(files).groupBy("repo_id").agg(
        (F.bool_or("workflow_surface") & F.bool_or("agent_surface")).alias("applicable"),
        F.count_if("docs_surface").alias("docs"),
        *[F.bool_or(k).alias(k) for k in R.OFFICIAL],
        F.sum("hazards").alias("hazards"),
        F.sum("raw_agents").alias("raw_agents"),
        F.count_if("escape").alias("escapes"),
        F.count_if("raw_model").alias("raw_models"),
        *[F.count_if(k).alias(k) for k in ("replay", "time_skipping", "fake_model", "wrong_docs")],
        (F.bool_or("validator") & ~F.bool_or("model_retry")).alias("no_retry"),
        (F.bool_or("deps") & ~F.bool_or("deps_type")).alias("no_deps_type"),
    )
    path = F.col("path")
    gov = files.groupBy("repo_id").agg(
        F.bool_or(path.startswith(".github/workflows/") | path.isin(R.GOVERNANCE)).alias("governance")
    )
    issues = tool_issues(facts).groupBy("repo_id").agg(F.count(F.lit(1)).alias("tool_issues"))
    return gov.join(sig, "repo_id", "left").join(issues, "repo_id", "left").fillna(0).fillna(False)


def gate_states(signals: DataFrame) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(g).alias("gate"), F.when(F.col("applicable"), F.expr(e)).otherwise("not-applicable").alias("state"))
            for g, e in R.STATES.items()
        ]
    )
    key = F.concat_ws("/", "gate", "state")
    soft_docs = (F.col("gate") == "doc-grounding") & (F.col("state") == "fragile") & (F.col("wrong_docs") == 0)
    level = lambda i, default: F.when(soft_docs, R.NO_DOCS_LEVEL[i]).otherwise(
        F.coalesce(P.lookup(key, {"/".join(k): v[i] for k, v in R.LEVELS.items()}), F.lit(default))
    )
    return (
        signals.select("repo_id", "applicable", "wrong_docs", F.explode(pairs).alias("g"))
        .select("repo_id", "applicable", "wrong_docs", "g.*")
        .withColumn("severity", level(0, "low"))
        .withColumn("confidence", level(1, "high"))
        .drop("wrong_docs")
    )


def detect(states: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Findings of weak gates, worst first, then findings of tools; a report cuts them by ``rank``."""
    gate, state, severity = F.col("gate"), F.col("state"), F.col("severity")
    replace = state.isin("broken", "unsafe") & gate.isin("workflow-determinism", "durable-agent-path", "tool-contracts")
    body = finding(
        gate, severity, F.col("confidence"), P.lookup(gate, R.TITLES), None, F.array(state),
        decision=F.when(replace, "replace").when(state == "unverified", "defer").otherwise("harden"),
        merge_gate=F.when(state == "unverified", "unverified").when(severity.isin("critical", "high"), "block-now").otherwise("block-changed-files"),
    )
    weak = states.where(~state.isin("sound", "hardened", "not-applicable"))
    rows = weak.select("repo_id", F.lit(".").alias("path"), F.lit(0).alias("part"), body.alias("f"))
    if merged is not None:
        applicable = states.where("applicable").select("repo_id").distinct()
        tool = F.col("tool")
        table = lambda i: P.lookup(tool, {k: v[i] for k, v in R.TOOL_FINDINGS.items()})
        ran = merged.where(tool.isin(list(R.TOOL_FINDINGS)) & (F.col("status") == "issues")).join(applicable, "repo_id", "left_semi")
        order = F.array_position(P.strings(list(R.TOOL_FINDINGS)), tool).cast("int")
        from_tool = finding(
            table(0), table(1), table(2), table(3), None, F.array("summary"), decision=table(4), merge_gate=table(5)
        )
        rows = union_findings(rows, ran.select("repo_id", F.lit(".").alias("path"), order.alias("part"), from_tool.alias("f")))
    flat = rows.select("repo_id", "path", "part", "f.*")
    # thirteen rows per repository at most
    w = Window.partitionBy("repo_id").orderBy("part", severity_rank(), "category")
    return flat.withColumn("rank", F.row_number().over(w)).drop("part")


def verdicts(states: DataFrame) -> DataFrame:
    wide = states.groupBy("repo_id").agg(
        F.bool_or("applicable").alias("applicable"),
        *[F.max(F.when(F.col("gate") == g, F.col("state"))).alias(g.replace("-", "_")) for g in R.STATES],
        F.count_if(F.col("state").isin("unsafe", "fragile", "unverified")).alias("n_weak"),
    )
    return wide.select("repo_id", F.expr(R.VERDICT).alias("verdict"))


def docs_ready(evidence: DataFrame) -> DataFrame:
    """Per repository: verified document evidence exists for both libraries."""
    subject = F.lower("subject")
    ok = F.col("status") == "verified"
    return evidence.groupBy("repo_id").agg(
        (F.bool_or(ok & subject.contains("temporal")) & F.bool_or(ok & subject.contains("pydantic"))).alias("docs_ready")
    )


