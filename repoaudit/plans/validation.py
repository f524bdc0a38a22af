"""Contract checks over summary, manifest and roll-up documents: every violation is one row.

The ordinal of a violation is the position of its rule, so the first failure of a document
is its minimum. Documents are parsed once per row; nested entries are checked in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.paths import lookup, strings
from repoaudit.plans.rollup import at, is_list, kind_of, python_list
from repoaudit.rules import catalog as C
from repoaudit.schemas import BUCKETS, CONFIDENCES, DEPENDENCY_STATUSES, SEVERITIES

# fixed values
TOP_KEYS = [
    "schema_version", "skill", "run_id", "repo_root", "generated_at", "overall_verdict", "rollup_bucket", "severity_counts",
    "findings", "dependency_status", "bootstrap_actions", "dependency_failures",
]
FINDING_KEYS = ["category", "severity", "confidence", "path"]
ACTION_KEYS = ["name", "kind", "status", "command", "details"]
FAILURE_KEYS = [
    "name", "kind", "required_for", "attempted_command", "failure_reason", "blocked_by_security", "blocked_by_permissions",
    "blocked_by_network",
]
MANIFEST_KEYS = ["schema_version", "skill", "runtime_features", "tools"]
CONTRACT_KEYS = ["schema_version", "skill", "overall_verdicts", "rollup_map"]
CATEGORY_STATES = [
    "missing", "theater", "partial", "enforced", "hardened", "unverified", "blocked", "not-applicable", "clean", "watch",
]
AUDIT_MODES = ["triage", "verified", "blocked", "not-applicable"]
LEVELS = ["provider-resolved", "family-resolved", "wrapper-resolved", "ambiguous"]
VERIFICATION = ["not-run", "triage-only", "verified"]


def violation(order: int, path: Column | str, message: Column | str) -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(order).alias("ord"), c(path).alias("json_path"), c(message).alias("message"))


def none() -> Column:
    return F.lit(None).cast("struct<ord:int,json_path:string,message:string>")


def rule(order: int, bad: Column, path, message) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), violation(order, path, message)).otherwise(none())


def entries(v: Column, path: str) -> Column:
    """Elements of a JSON list; empty when it is not a list."""
    return F.when(is_list(v, path), F.try_variant_get(v, path, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def keys_of(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), strings([]))


def lacking(v: Column, keys: list[str]) -> Column:
    return F.array_sort(F.array_except(strings(keys), keys_of(v)))


def each(v: Column, path: str, order: int, check) -> Column:
    """Violations of a check applied to every element with its JSON path."""

    def one(item: Column, i: Column) -> Column:
        where = F.concat(F.lit(path.replace("$.", "") + "["), i.cast("string"), F.lit("]"))
        return F.array(*check(item, where, order))

    return F.flatten(F.transform(entries(v, path), one))


def required(item: Column, where: Column, order: int, keys: list[str]) -> Column:
    miss = lacking(item, keys)
    return rule(order, F.size(miss) > 0, where, F.concat(F.lit("missing keys: "), python_list(miss)))


def field_in(item: Column, where: Column, order: int, key: str, allowed: list[str]) -> Column:
    value = F.coalesce(at(item, f"$.{key}"), F.lit(""))
    return rule(order, ~value.isin(allowed), where, F.concat(F.lit(f"invalid {key}: "), value))


def expand(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def least(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """The first violation of each row alone, so that no sort ever holds the others."""
    return expand(rows, keys, F.array(F.array_min(found)))


def validate_summaries(summaries: DataFrame, first: bool = False) -> DataFrame:
    """Keys, enumerations, types and cross-field rules of audit summaries (repo_id, domain, json).

    ``first`` keeps the first violation of each row; ``first_violations`` then joins rows of one document.
    """
    rows = summaries.select("repo_id", "domain", "json", F.try_parse_json("json").alias("v"))
    v, domain = F.col("v"), F.col("domain")
    text = lambda k: F.coalesce(at(v, f"$.{k}"), F.lit(""))
    verdict_known = lookup(F.concat_ws("/", domain, text("overall_verdict")), {f"{d}/{x}": "1" for d, m in C.VERDICT_BUCKETS.items() for x in m}).isNotNull()
    miss = lacking(v, TOP_KEYS)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    blocked = text("dependency_status") == "blocked"

    def severity_is_int(s: str) -> Column:
        return F.coalesce(kind_of(v, f"$.severity_counts.{s}"), F.lit("")) == "BIGINT"

    def finding_checks(item: Column, where: Column, o: int) -> list[Column]:
        line = kind_of(item, "$.line")
        return [
            required(item, where, o, FINDING_KEYS),
            field_in(item, where, o + 1, "severity", SEVERITIES),
            field_in(item, where, o + 2, "confidence", CONFIDENCES),
            F.when(
                F.coalesce(line == "BIGINT", F.lit(False)) & (F.coalesce(at(item, "$.line", "int"), F.lit(1)) < 1),
                violation(o + 3, where, "line must be positive"),
            ).otherwise(none()),
        ]

    def state_checks(item: Column, where: Column, o: int) -> list[Column]:
        return [field_in(item, where, o, "state", CATEGORY_STATES)]

    ids = F.filter(F.transform(entries(v, "$.categories"), lambda c: at(c, "$.id")), lambda x: x.isNotNull())
    top = [
        rule(1, F.size(miss) > 0, "summary", F.concat(F.lit("missing keys: "), python_list(miss))),
        rule(2, ~text("dependency_status").isin(DEPENDENCY_STATUSES), "dependency_status", F.concat(F.lit("invalid dependency_status: "), text("dependency_status"))),
        rule(3, ~verdict_known, "overall_verdict", F.concat(F.lit("invalid overall_verdict: "), text("overall_verdict"))),
        rule(4, ~text("rollup_bucket").isin(BUCKETS), "rollup_bucket", F.concat(F.lit("invalid rollup_bucket: "), text("rollup_bucket"))),
        rule(5, ~is_list(v, "$.bootstrap_actions"), "bootstrap_actions", "must be a list"),
        rule(6, ~is_list(v, "$.dependency_failures"), "dependency_failures", "must be a list"),
        F.when(blocked & (F.size(entries(v, "$.dependency_failures")) == 0), violation(7, "dependency_failures", "blocked requires at least one failure")).otherwise(none()),
        rule(8, ~is_list(v, "$.findings"), "findings", "must be a list"),
        *[rule(9 + i, ~severity_is_int(s), f"severity_counts.{s}", "must be an integer") for i, s in enumerate(SEVERITIES)],
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), violation(13, "categories", "category ids must be unique")).otherwise(none()),
    ]
    nested = F.concat(
        each(v, "$.bootstrap_actions", 20, lambda i, w, o: [required(i, w, o, ACTION_KEYS)]),
        each(v, "$.dependency_failures", 21, lambda i, w, o: [required(i, w, o, FAILURE_KEYS)]),
        each(v, "$.findings", 22, finding_checks),
        each(v, "$.categories", 26, state_checks),
    )
    broken = F.array(violation(0, "summary", "not a JSON object"))
    keep = least if first else expand
    return keep(rows, ["repo_id", "domain"], F.when(is_object, F.concat(F.array(*top), nested)).otherwise(broken))


def validate_surface_summaries(summaries: DataFrame) -> DataFrame:
    """Freshness rules: severities against mode and resolution, surface references, mode consistency."""
    rows = summaries.select("repo_id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    mode = F.coalesce(at(v, "$.audit_mode"), F.lit(""))
    ids = F.transform(entries(v, "$.surface_resolution"), lambda s: at(s, "$.surface_id"))
    dependency = F.coalesce(at(v, "$.dependency_status"), F.lit(""))
    verified = F.exists(entries(v, "$.doc_verification"), lambda d: F.coalesce(at(d, "$.status") == "verified", F.lit(False)))
    hit = lambda o, bad, where, msg: F.when(F.coalesce(bad, F.lit(False)), violation(o, where, msg)).otherwise(none())

    def known(item: Column, where: Column, o: int) -> Column:
        sid = at(item, "$.surface_id")
        return hit(o, sid.isNotNull() & (F.size(ids) > 0) & ~F.array_contains(ids, sid), where, "unknown surface_id")

    def finding_checks(item: Column, where: Column, o: int) -> list[Column]:
        severity = F.coalesce(at(item, "$.severity"), F.lit(""))
        level = F.coalesce(at(item, "$.resolution_level"), F.lit(""))
        checked = F.coalesce(at(item, "$.verification_status"), F.lit(""))
        hard = severity.isin("critical", "high")
        return [
            field_in(item, where, o, "resolution_level", LEVELS),
            field_in(item, where, o + 1, "verification_status", VERIFICATION),
            known(item, where, o + 2),
            hit(o + 3, (mode == "triage") & severity.isin("critical", "high", "medium"), where, "triage findings may not exceed low"),
            hit(o + 4, (level == "family-resolved") & hard, where, "family-resolved findings may not exceed medium"),
            hit(o + 5, hard & (checked != "verified"), where, "high-severity findings require verified docs"),
            hit(o + 6, (mode == "verified") & (checked == "not-run"), where, "verified audit may not contain not-run findings"),
        ]

    top = F.array(
        rule(0, ~mode.isin(AUDIT_MODES), "audit_mode", F.concat(F.lit("invalid audit_mode: "), mode)),
        hit(1, F.coalesce(at(v, "$.overall_verdict"), F.lit("")) != mode, "overall_verdict", "must equal audit_mode"),
        hit(2, (mode == "blocked") & (dependency != "blocked"), "audit_mode", "blocked mode requires blocked dependency_status"),
        hit(3, (mode == "verified") & ~verified, "doc_verification", "verified mode requires a verified entry"),
        hit(4, (mode == "not-applicable") & (F.size(ids) > 0), "surface_resolution", "not-applicable mode has no surfaces"),
    )
    nested = F.concat(
        each(v, "$.surface_resolution", 10, lambda i, w, o: [field_in(i, w, o, "resolution_level", LEVELS)]),
        each(v, "$.doc_verification", 11, lambda i, w, o: [known(i, w, o)]),
        each(v, "$.findings", 12, finding_checks),
    )
    return expand(rows, ["repo_id"], F.concat(top, nested))


def validate_rollup(runs: DataFrame, run_id: str) -> DataFrame:
    """Roll-up rows: run identity, dependency status, and a bucket exactly where the status allows one."""
    gone = F.col("status").isin("missing", "invalid")
    bucket = F.coalesce("rollup_bucket", F.lit(""))
    found = F.array(
        rule(1, F.col("run_id") != run_id, "run_id", "must match top-level run_id"),
        rule(2, ~F.col("dependency_status").isin(DEPENDENCY_STATUSES), "dependency_status", "unsupported dependency_status"),
        rule(3, ~gone & ~bucket.isin(BUCKETS), "rollup_bucket", "unsupported rollup_bucket"),
        rule(4, gone & (bucket != ""), "rollup_bucket", "must be empty for missing or invalid runs"),
    )
    return expand(runs, ["repo_id", "domain"], found)


def validate_contracts(contracts: DataFrame) -> DataFrame:
    """Verdict contracts (skill, json): verdict list and bucket map agree, buckets are known, no extra keys."""
    rows = contracts.select("skill", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    verdicts = F.transform(entries(v, "$.overall_verdicts"), lambda x: x.cast("string"))
    mapping = F.coalesce(F.try_variant_get(v, "$.rollup_map", "map<string,string>"), F.create_map().cast("map<string,string>"))
    names = F.map_keys(mapping)
    extra = F.array_sort(F.array_except(keys_of(v), strings(CONTRACT_KEYS)))
    lost, added = F.array_sort(F.array_except(verdicts, names)), F.array_sort(F.array_except(names, verdicts))
    bad = F.array_sort(F.transform(F.filter(F.map_entries(mapping), lambda e: ~e["value"].isin(BUCKETS)), lambda e: e["key"]))
    listing = lambda text, a: F.concat(F.lit(text), F.array_join(a, ", "))
    found = F.array(
        rule(1, F.size(extra) > 0, "contract", listing("unsupported keys: ", extra)),
        rule(2, F.coalesce(at(v, "$.schema_version"), F.lit("")) != "1.0", "schema_version", "must be 1.0"),
        rule(3, F.coalesce(at(v, "$.skill"), F.lit("")) != F.col("skill"), "skill", "must equal its own name"),
        rule(4, F.size(verdicts) == 0, "overall_verdicts", "must be a non-empty string list"),
        rule(5, F.size(lost) > 0, "rollup_map", listing("missing verdicts: ", lost)),
        rule(6, F.size(added) > 0, "rollup_map", listing("unexpected verdicts: ", added)),
        rule(7, F.size(bad) > 0, "rollup_map", listing("invalid buckets for: ", bad)),
    )
    return expand(rows, ["skill"], found)


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """Runtime dependency manifests (skill, json): keys, identity and string lists."""
    rows = manifests.select("skill", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    extra = F.array_sort(F.array_except(keys_of(v), strings(MANIFEST_KEYS)))
    texts = lambda k: F.forall(entries(v, f"$.{k}"), lambda x: F.schema_of_variant(x) == "STRING")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = F.array(
        rule(1, F.size(extra) > 0, "manifest", F.concat(F.lit("unsupported keys: "), F.array_join(extra, ", "))),
        rule(2, F.coalesce(at(v, "$.schema_version"), F.lit("")) == "", "schema_version", "must be a non-empty string"),
        rule(3, F.coalesce(at(v, "$.skill"), F.lit("")) != F.col("skill"), "skill", "must equal its own name"),
        *[rule(4 + i, ~is_list(v, f"$.{k}"), k, "must be a list") for i, k in enumerate(("runtime_features", "tools"))],
        *[rule(6 + i, ~texts(k), k, "must contain only strings") for i, k in enumerate(("runtime_features", "tools"))],
    )
    return expand(rows, ["skill"], F.when(is_object, found).otherwise(F.array(violation(0, "manifest", "must be valid JSON"))))


def first_violations(violations: DataFrame, keys: list[str]) -> DataFrame:
    """The first failure per document, for callers that stop there."""
    return violations.groupBy(*keys).agg(F.min(F.struct("ord", "json_path", "message")).alias("w")).select(*keys, "w.*")
