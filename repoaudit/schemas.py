"""Column contracts of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITIES = ["critical", "high", "medium", "low"]
CONFIDENCES = ["high", "medium", "low"]
BUCKETS = ["blocked", "red", "yellow", "green", "not-applicable"]
DEPENDENCY_STATUSES = ["ready", "auto-installed", "blocked"]
TOOL_STATUSES = ["passed", "issues", "failed", "skipped"]

FILES = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

# one struct per finding inside a file; repo_id and path come from the row
FINDING = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("merge_gate", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("cue", T.StringType()),
        T.StructField("replacement", T.StringType()),
        T.StructField("removal_target", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

TOOL_RUNS = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("tool", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("issue_count", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("details", T.ArrayType(T.StringType())),
        T.StructField("payload", T.StringType()),
    ]
)

DEPENDENCY_FAILURE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("required_for", T.StringType()),
        T.StructField("attempted_command", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("blocked_by_security", T.BooleanType()),
        T.StructField("blocked_by_permissions", T.BooleanType()),
        T.StructField("blocked_by_network", T.BooleanType()),
    ]
)
