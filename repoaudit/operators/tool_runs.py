"""Results of external tools as a table: merging batches, and totals from their JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.paths import strings
from repoaudit.operators.findings import number_within

ISSUES_SCHEMA = "struct<issues: array<map<string, string>>>"


def tool_details(runs: DataFrame) -> DataFrame:
    """``repo_id, tool, seq, detail``: the details of all batches of a tool in order, as numbered rows.

    The detail lists of single batches are spread and numbered over ranges, so a tool with any number of them meets in
    no task.
    """
    spread = runs.select("repo_id", "tool", "batch", F.posexplode("details").alias("pos", "detail"))
    return number_within(spread, ["repo_id", "tool"], ["batch", "pos", "detail"]).select("repo_id", "tool", "seq", "detail")


def merge_tool_runs(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One run per repository and tool: worst status, summed issues, all details in order as one list.

    The list is for reports; ``tool_details`` gives the same details as rows.

    ``failed`` beats ``issues`` beats ``passed``. The exit code is that of the last run
    with the winning status. The details of one tool run are one list, as in its batches.
    ``expected`` (repo_id, tool) adds skipped rows for tools without any run.
    """
    keys = ["repo_id", "tool"]
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "issues", 1).otherwise(0)
    merged = runs.groupBy(*keys).agg(
        F.max(F.struct(rank.alias("rank"), "batch", "exit_code")).alias("worst"),
        F.sum("issue_count").cast("int").alias("issue_count"),
        F.count(F.lit(1)).alias("batches"),
    )
    lists = runs.where(F.size("details") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("batch", "details"))).alias("lists"))
    whole = lists.select(*keys, F.flatten(F.transform("lists", lambda b: b["details"])).alias("details"))
    status = F.element_at(F.array(F.lit("passed"), F.lit("issues"), F.lit("failed")), F.col("worst.rank") + 1)
    tool, n = F.col("tool"), F.col("issue_count")
    out = merged.join(whole, keys, "left").select(
        *keys,
        status.alias("status"),
        F.concat(tool, F.lit(" batched first-party targets ("), F.col("batches").cast("string"), F.lit(" chunk(s))")).alias("command"),
        F.when(F.col("worst.rank") > 0, F.col("worst.exit_code")).otherwise(0).alias("exit_code"),
        "issue_count",
        F.when(status == "failed", F.concat(tool, F.lit(" execution failed in at least one first-party target batch.")))
        .when(
            (status == "issues") & (n > 0),
            F.concat(tool, F.lit(" reported "), n.cast("string"), F.lit(" finding(s) across first-party targets.")),
        )
        .when(
            status == "issues",
            F.concat(tool, F.lit(" returned a non-zero audit result across first-party targets.")),
        )
        .otherwise(
            F.concat(tool, F.lit(" ran successfully with no machine-detected findings across first-party targets."))
        )
        .alias("summary"),
        F.coalesce("details", strings([])).alias("details"),
    )
    if expected is None:
        return out
    skipped = expected.join(out, keys, "left_anti").select(
        *keys,
        F.lit("skipped").alias("status"),
        F.lit("").alias("command"),
        F.lit(0).alias("exit_code"),
        F.lit(0).alias("issue_count"),
        F.concat("tool", F.lit(" was skipped because no first-party targets were detected.")).alias("summary"),
        strings([]).alias("details"),
    )
    return out.unionByName(skipped)


def issue_totals(runs: DataFrame) -> DataFrame:
    """Sum of the list lengths per issue key in the runs' JSON payloads; non-list values are ignored."""
    parsed = runs.select(
        "repo_id", "tool", F.from_json("payload", ISSUES_SCHEMA, {"mode": "PERMISSIVE"})["issues"].alias("issues")
    )
    return (
        parsed.select("repo_id", "tool", F.explode("issues").alias("issue"))
        .select("repo_id", "tool", F.explode("issue").alias("key", "value"))
        .where((F.col("key") != "file") & F.col("value").startswith("["))
        .groupBy("repo_id", "tool", "key")
        .agg(F.sum(F.json_array_length("value")).alias("total"))
    )
