"""Roll-up of audit summaries: run classification, health, clusters, ranked actions, unknowns.

Every repository has at most one row per catalog domain, so all lists built here are
bounded by the catalog (17 entries), never by data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.functions.paths import lookup, strings
from repoaudit.functions.text import line_array
from repoaudit.rules import catalog as R
from repoaudit.schemas import BUCKETS, DEPENDENCY_STATUSES, SEVERITIES

FAILURES = "array<struct<name: string, kind: string, failure_reason: string, attempted_command: string>>"


def catalog_rows(repos: DataFrame, skills: dict[str, str] | None = None) -> DataFrame:
    """Every repository with every domain, in catalog order. No join: the catalog is a literal."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(d).alias("domain"),
                F.lit((skills or {}).get(d, R.skill_of(d))).alias("skill"),
                F.lit(c).alias("cluster"),
            )
            for i, (d, c) in enumerate(R.DOMAINS.items())
        ]
    )
    return repos.select("repo_id").distinct().select("repo_id", F.explode(rows).alias("c")).select("repo_id", "c.*")


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    """Type name of a JSON value: ARRAY.., OBJECT.., STRING, ...; null when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_list(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path).startswith("ARRAY"), F.lit(False))


def python_list(items: Column) -> Column:
    """``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def parse_summaries(rows: DataFrame) -> DataFrame:
    """Fields of the JSON documents that the roll-up needs; text and parsed form end here."""
    v, findings = F.col("v"), F.col("findings")
    parsed = rows.select("repo_id", "domain", F.try_parse_json("json").alias("v"), F.json_object_keys("json").alias("keys"))
    # text with a point is no whole number; a cast would find that out by raising an error
    fraction = (kind_of(v, "$.schema_version") == "STRING") & at(v, "$.schema_version").contains(".")
    version = F.when(fraction, 1).otherwise(F.coalesce(at(v, "$.schema_version", "int"), F.lit(1)))
    # an entry of a version 2 record stands for all findings of its category; both are read once a document, not once an entry
    listed = parsed.select(
        "*",
        F.try_variant_get(v, "$.findings", "array<variant>").alias("findings"),
        (version >= 2).alias("counted"),
    )
    failures = F.try_variant_get(v, "$.dependency_failures", FAILURES)
    text = lambda f, k: F.when(F.schema_of_variant(F.try_variant_get(f, f"$.{k}", "variant")) == "STRING", at(f, f"$.{k}"))
    number = lambda f: F.when(F.col("counted"), F.greatest(F.coalesce(at(f, "$.count", "long"), F.lit(1)), F.lit(1))).otherwise(1).cast("long")
    categories = F.transform(
        findings, lambda f: F.struct(F.coalesce(*[text(f, k) for k in ("category", "gate", "domain", "kind")]).alias("name"), number(f).alias("n"))
    )
    # null unless the value is a list
    objects = F.forall(findings, lambda f: F.schema_of_variant(f).startswith("OBJECT"))
    fields = listed.select(
        "repo_id",
        "domain",
        # text that is not valid has no parsed form, and only an object has keys
        (v.isNotNull() & F.col("keys").isNotNull()).alias("is_object"),
        F.coalesce("keys", strings([])).alias("keys"),
        *[F.coalesce(at(v, f"$.{k}"), F.lit("")).alias(k) for k in ("run_id", "overall_verdict", "rollup_bucket", "dependency_status")],
        F.coalesce(at(v, "$.skill"), F.lit("")).alias("actual_skill"),
        (F.coalesce(kind_of(v, "$.overall_verdict"), F.lit("")) == "STRING").alias("verdict_is_text"),
        is_list(v, "$.bootstrap_actions").alias("actions_list"),
        is_list(v, "$.dependency_failures").alias("failures_list"),
        F.coalesce(objects, F.lit(False)).alias("findings_list"),
        F.coalesce(failures, F.array().cast(FAILURES)).alias("failures"),
        *[at(v, f"$.severity_counts.{s}", "int").alias(s) for s in SEVERITIES],
        F.filter(F.coalesce(categories, F.array().cast("array<struct<name: string, n: bigint>>")), lambda c: c["name"].isNotNull()).alias("names"),
    )
    # the list is projected first: inlined below, it would be rebuilt for every element
    return fields.select(
        *[c for c in fields.columns if c != "names"], top_categories(F.col("names"), 3).alias("top_categories")
    )


def top_categories(names: Column, n: int) -> Column:
    """Most frequent names of one short list of (name, n) without nulls, first occurrence breaking ties."""
    times = lambda c: F.aggregate(names, F.lit(0).cast("long"), lambda k, x: k + F.when(x["name"] == c, x["n"]).otherwise(0))
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(F.transform(names, lambda x: x["name"])),
            lambda c, i: F.struct((-times(c)).alias("k"), i.alias("i"), c.alias("c")),
        )
    )
    return F.slice(F.transform(ranked, lambda r: r["c"]), 1, n)


def classify_runs(summaries: DataFrame, run_id: Column | str, repos: DataFrame, artifacts: DataFrame | None = None, skills: dict[str, str] | None = None) -> DataFrame:
    """One classified row per repository and domain.

    ``summaries``: repo_id, domain, json. ``artifacts``: repo_id, domain, kind (report, brief).
    The checks run in a fixed order; the first that fails names the note.
    """
    expected = F.lit(run_id) if isinstance(run_id, str) else run_id
    rows = catalog_rows(repos, skills).join(parse_summaries(summaries), ["repo_id", "domain"], "left")
    missing_keys = F.array_sort(F.array_except(strings(R.REQUIRED_SUMMARY_KEYS), F.col("keys")))
    dash = lambda c: F.when(F.col(c) == "", F.lit("-")).otherwise(F.col(c))
    blocked = F.col("dependency_status") == "blocked"
    bad = lambda note: F.struct(F.lit("invalid").alias("status"), note.alias("note"))
    of = lambda status, note: F.struct(F.lit(status).alias("status"), F.lit(note).alias("note"))
    no_severity = F.lit(False)
    for s in SEVERITIES:
        no_severity = no_severity | F.col(s).isNull()
    result = (
        F.when(F.col("is_object").isNull(), of("missing", "summary file not found"))
        .when(~F.col("is_object"), of("invalid", "invalid: not a JSON object"))
        .when(F.size("keys") == 0, of("missing", "summary file not found"))
        .when((F.col("actual_skill") != "") & (F.col("actual_skill") != F.col("skill")), bad(F.concat(F.lit("summary skill mismatch: expected "), F.col("skill"), F.lit(", got "), F.col("actual_skill"))))
        .when((expected != "") & (F.col("run_id") != expected), bad(F.concat(F.lit("run_id mismatch: expected "), expected, F.lit(", got "), dash("run_id"))))
        .when(F.size(missing_keys) > 0, bad(F.concat(F.lit("summary missing required keys: "), python_list(missing_keys))))
        .when(~F.col("verdict_is_text") | (F.col("overall_verdict") == ""), of("invalid", "overall_verdict must be a non-empty string"))
        .when(~F.col("rollup_bucket").isin(BUCKETS), bad(F.concat(F.lit("invalid rollup_bucket: "), dash("rollup_bucket"))))
        .when(~F.col("dependency_status").isin(DEPENDENCY_STATUSES), bad(F.concat(F.lit("invalid dependency_status: "), dash("dependency_status"))))
        .when(~F.col("actions_list"), of("invalid", "bootstrap_actions must be a list"))
        .when(~F.col("failures_list"), of("invalid", "dependency_failures must be a list"))
        .when(blocked & (F.size("failures") == 0), of("invalid", "dependency_status=blocked requires at least one dependency_failure"))
        .when(no_severity, of("invalid", "severity_counts must contain integer critical/high/medium/low keys"))
        .when(~F.col("findings_list"), of("invalid", "findings must be a list of objects"))
        .when(F.col("rollup_bucket") == "not-applicable", of("not-applicable", "child skill marked this domain not applicable"))
        .when(blocked | (F.col("rollup_bucket") == "blocked"), of("blocked", ""))
        .otherwise(of("present", ""))
    )
    rows = rows.withColumn("r", result)
    if artifacts is None:
        rows = rows.withColumn("has_report", F.lit(True)).withColumn("has_brief", F.lit(True))
    else:
        seen = artifacts.groupBy("repo_id", "domain").agg(
            F.bool_or(F.col("kind") == "report").alias("has_report"), F.bool_or(F.col("kind") == "brief").alias("has_brief")
        )
        rows = rows.join(seen, ["repo_id", "domain"], "left").fillna(False, ["has_report", "has_brief"])
    return annotate(rows)


def annotate(rows: DataFrame) -> DataFrame:
    """Artifact gate, blanking of unusable rows, and the note precedence."""
    usable = ~F.col("r.status").isin("missing", "invalid")
    place = lambda kind: F.concat(F.col("domain"), F.lit("/" + kind))
    gap = F.concat_ws(
        "; ",
        F.when(~F.col("has_report"), F.concat(F.lit("human report missing at "), place("report.md"))),
        F.when(~F.col("has_brief"), F.concat(F.lit("agent brief missing at "), place("agent-brief.md"))),
    )
    gated = usable & (gap != "")
    status = F.when(gated, "invalid").otherwise(F.col("r.status"))
    blank = status.isin("missing", "invalid")
    verdict = F.when(blank, "").otherwise(F.col("overall_verdict"))
    bucket = F.when(blank, "").otherwise(F.col("rollup_bucket"))
    dependency = F.coalesce(F.nullif("dependency_status", F.lit("")), F.lit("ready"))
    first = F.try_element_at("failures", F.lit(1))
    base_note = F.when(gated, gap).otherwise(F.col("r.note"))
    note = (
        F.when(status == "invalid", F.when(base_note == "", "child artifact contract failed validation").otherwise(base_note))
        .when(
            dependency == "blocked",
            F.concat(
                F.coalesce(first["name"], F.lit("dependency")), F.lit(": "),
                F.coalesce(first["failure_reason"], F.lit("dependency bootstrap blocked the child skill")),
            ),
        )
        .when(bucket == "blocked", F.when(verdict == "", "child summary declared a blocked rollup bucket").otherwise(verdict))
        .when((F.col("domain") == "llm-api-freshness") & (verdict == "triage"), "this run only produced local surface triage; current docs were not verified")
        .when((F.col("domain") == "llm-api-freshness") & (verdict == "verified"), "current provider docs were verified for the detected surfaces")
        .otherwise(base_note)
    )
    incomplete = F.lit(False)
    for s in SEVERITIES:
        incomplete = incomplete | F.col(s).isNull()
    return rows.select(
        "repo_id", "ord", "domain", "cluster", "skill",
        status.alias("status"),
        dependency.alias("dependency_status"),
        first["name"].alias("failure_name"),
        verdict.alias("child_verdict"),
        bucket.alias("rollup_bucket"),
        *[F.when(incomplete, 0).otherwise(F.col(s)).alias(s) for s in SEVERITIES],
        F.coalesce("top_categories", strings([])).alias("top_categories"),
        note.alias("notes"),
        "has_report",
        "has_brief",
    )


def health(runs: DataFrame) -> DataFrame:
    """Overall health, coverage and the missing and invalid lists per repository."""
    gone = F.col("status").isin("missing", "invalid")
    agg = runs.groupBy("repo_id").agg(
        F.count_if(~gone).alias("n_present"),
        F.count_if(gone).alias("n_gone"),
        F.count_if(F.col("status") == "not-applicable").alias("n_na"),
        F.bool_or((F.col("status") == "blocked") | (F.col("rollup_bucket") == "red")).alias("blocked"),
        F.bool_or(F.col("rollup_bucket") == "yellow").alias("watch"),
        *[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("ord", "skill")))), lambda x: x["skill"]).alias(out)
            for s, out in (("missing", "missing_skills"), ("invalid", "invalid_summaries"))
        ],
    )
    state = (
        F.when(F.col("n_present") == 0, "not-applicable")
        .when((F.col("n_na") == F.col("n_present")) & (F.col("n_gone") == 0), "not-applicable")
        .when(F.col("blocked"), "blocked")
        .when(F.col("n_gone") >= 3, "partial-coverage")
        .when(F.col("watch") | (F.col("n_gone") > 0), "watch")
        .otherwise("healthy")
    )
    line = F.when(F.col("n_present") == 0, R.HEALTH_LINES["none"]).otherwise(lookup(state, R.HEALTH_LINES))
    return agg.select(
        "repo_id",
        state.alias("overall_health"),
        F.when(F.col("n_gone") == 0, "complete").otherwise("partial").alias("coverage_status"),
        line.alias("summary_line"),
        "missing_skills",
        "invalid_summaries",
    )


def action_of(partial: Column) -> Column:
    """Recommended action of one run row."""
    domain, status, bucket = F.col("domain"), F.col("status"), F.col("rollup_bucket")
    unblock = F.when(
        F.col("failure_name").isNotNull(),
        F.concat(
            F.lit("Unblock "), F.col("skill"), F.lit(" first: restore `"), F.col("failure_name"),
            F.lit("` so the audit can run before trusting "), domain, F.lit(" coverage."),
        ),
    ).otherwise(F.concat(F.lit("Unblock "), F.col("skill"), F.lit(" first: restore its runtime prerequisites before trusting "), domain, F.lit(" coverage.")))
    return (
        F.when(F.col("dependency_status") == "blocked", unblock)
        .when(status.isin("missing", "invalid"), F.when(partial, R.COVERAGE_ACTION))
        .when(status == "not-applicable", F.lit(None).cast("string"))
        .when(bucket.isin("blocked", "red"), lookup(domain, R.HIGH_ACTIONS))
        .when(bucket == "yellow", lookup(domain, R.WATCH_ACTIONS))
    )


def recommended_actions(runs: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` distinct actions in catalog order."""
    gone = F.col("status").isin("missing", "invalid")
    # seventeen rows per repository: the flag and the list come from one aggregation
    lists = runs.groupBy("repo_id").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", gone.alias("gone"), action_of(F.lit(True)).alias("action")))
        ).alias("rows")
    )
    # the coverage action only exists where a row is gone, which is what makes coverage partial
    texts = F.filter(F.transform("rows", lambda r: r["action"]), lambda a: a.isNotNull())
    return lists.select("repo_id", F.slice(F.array_distinct(texts), 1, n).alias("top_actions"))


def risk_label() -> Column:
    bucket = F.col("rollup_bucket")
    return (
        F.when(F.col("dependency_status") == "blocked", "dependency-blocked")
        .when(F.col("status").isin("missing", "invalid"), "coverage-gap")
        .when((F.col("status") == "not-applicable") | (bucket == "not-applicable"), "not-applicable")
        .when(bucket.isin("blocked", "red"), "high-risk")
        .when(F.lower("child_verdict") == "triage", "trust-gap")
        .when(bucket == "yellow", "watch")
        .otherwise("stable")
    )


def domain_records(runs: DataFrame) -> DataFrame:
    """Run rows with risk rank, label, reason and evidence gaps."""
    label = risk_label()
    gaps = F.array_compact(
        F.array(
            F.when(F.col("status").isin("missing", "invalid"), F.concat("status", F.lit("-summary"))),
            F.when(~F.col("has_report"), F.lit("missing-human-report")),
            F.when(~F.col("has_brief"), F.lit("missing-agent-brief")),
        )
    )
    return (
        runs.withColumn("risk_label", label)
        .withColumn("risk_rank", lookup(F.col("risk_label"), {k: str(v) for k, v in R.RISK_RANK.items()}).cast("int"))
        .withColumn("why_now", lookup(F.col("risk_label"), R.WHY_NOW))
        .withColumn("evidence_gaps", gaps)
    )


def unknowns(records: DataFrame) -> DataFrame:
    items = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(flag),
                    F.struct(
                        F.lit(f"missing-{label}").alias("kind"),
                        F.concat(F.lit(f"{label} not produced at "), F.col("domain"), F.lit("/" + name)).alias("detail"),
                    ),
                )
                for flag, label, name in (("has_report", "human-report", "report.md"), ("has_brief", "agent-brief", "agent-brief.md"))
            ],
            F.when(F.col("risk_label") == "trust-gap", F.struct(F.lit("trust-gap").alias("kind"), F.lit(R.TRUST_GAP).alias("detail"))),
        )
    )
    return records.select("repo_id", F.col("domain").alias("scope"), F.explode(items).alias("u")).select("repo_id", "scope", "u.*")


def clusters(records: DataFrame) -> DataFrame:
    """Status, top categories and summary line per repository and cluster."""
    risk = F.col("risk_label")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "domain", "top_categories")))
    agg = records.groupBy("repo_id", "cluster").agg(
        F.bool_and(F.col("status") == "not-applicable").alias("na"),
        F.bool_or(risk.isin("dependency-blocked", "high-risk")).alias("blocked"),
        F.bool_or(risk.isin("watch", "trust-gap", "coverage-gap")).alias("watch"),
        ordered.alias("m"),
    ).withColumn(
        "names",
        F.transform(F.flatten(F.transform("m", lambda x: x["top_categories"])), lambda c: F.struct(c.alias("name"), F.lit(1).cast("long").alias("n"))),
    )
    status = F.when(F.col("na"), "not-applicable").when(F.col("blocked"), "blocked").when(F.col("watch"), "watch").otherwise("healthy")
    title = lookup(F.col("cluster"), R.CLUSTERS)
    names = F.array_join(F.transform("m", lambda x: x["domain"]), ", ")
    summary = (
        F.when(status == "blocked", F.concat(title, F.lit(" is the main blocker cluster right now, driven by "), names, F.lit(".")))
        .when(status == "watch", F.concat(title, F.lit(" still needs cleanup or stronger proof before "), names, F.lit(" can be trusted as stable.")))
        .when(status == "not-applicable", F.concat(title, F.lit(" is not currently in play for this repository.")))
        .otherwise(F.concat(title, F.lit(" shows no visible blocker from the current run across "), names, F.lit(".")))
    )
    order = F.array_position(strings(list(R.CLUSTERS)), F.col("cluster")).cast("int")
    return agg.select(
        "repo_id", "cluster", order.alias("ord"), title.alias("title"), status.alias("status"),
        top_categories(F.col("names"), 4).alias("top_categories"),
        summary.alias("summary"),
    )


def ordered_actions(records: DataFrame, health_rows: DataFrame, carry_bucket: bool = True) -> DataFrame:
    """Distinct actions ranked by risk. ``carry_bucket=False`` drops the bucket before the action lookup."""
    rows = records.join(health_rows.select("repo_id", "coverage_status"), "repo_id")
    source = rows if carry_bucket else rows.withColumn("rollup_bucket", F.lit(""))
    own = source.select(
        "repo_id", "domain", "cluster", F.col("risk_rank").alias("priority_rank"), action_of(F.col("coverage_status") == "partial").alias("action"), "why_now"
    ).where("action is not null and priority_rank < 8")
    gap = health_rows.where("coverage_status = 'partial'").select(
        "repo_id", F.lit("overall").alias("domain"), F.lit("cross-cutting").alias("cluster"), F.lit(4).alias("priority_rank"),
        F.lit(R.COVERAGE_GAP_ACTION).alias("action"), F.lit(R.COVERAGE_GAP_WHY).alias("why_now"),
    )
    order = ["priority_rank", "domain"]
    first = Window.partitionBy("repo_id", "action").orderBy(*order)
    rank = Window.partitionBy("repo_id").orderBy(*order, "action")
    tier = F.when(F.col("priority_rank") <= 1, "now").when(F.col("priority_rank") <= 3, "next").otherwise("later")
    return (
        own.unionByName(gap)
        .withColumn("seen", F.row_number().over(first))
        .where("seen = 1")
        .withColumn("priority", F.row_number().over(rank))
        .withColumn("tier", tier)
        .drop("seen")
    )


def teaching_line(cluster_rows: DataFrame) -> DataFrame:
    agg = cluster_rows.groupBy("repo_id").agg(
        F.min(F.when(F.col("status") == "blocked", F.struct("ord", "cluster"))).alias("first"),
        F.bool_or(F.col("status") == "watch").alias("watch"),
    )
    line = F.coalesce(lookup(F.col("first.cluster"), R.TEACHING), F.when(F.col("watch"), R.TEACHING_WATCH).otherwise(R.TEACHING_OK))
    return agg.select("repo_id", line.alias("teaching_line"))


def final_state(runs: DataFrame) -> DataFrame:
    """Worker status and detail that the final summary leaves in the run state."""
    status, verdict = F.col("status"), F.col("child_verdict")
    blocked = (status == "blocked") | (F.col("dependency_status") == "blocked")
    red = F.col("rollup_bucket").isin("blocked", "red")
    or_text = lambda text: F.when(verdict == "", text).otherwise(verdict)
    worker = (
        F.when(blocked, "blocked")
        .when(status == "present", F.when(red, "blocked").otherwise("complete"))
        .when(status.isin("not-applicable", "invalid"), status)
        .otherwise("missing")
    )
    detail = (
        F.when(blocked, F.coalesce("failure_name", or_text("dependency bootstrap blocked")))
        .when(status == "present", F.when(red, or_text("high-risk findings")).otherwise(or_text("artifact ready")))
        .when(status == "not-applicable", "domain not applicable")
        .when(status == "invalid", or_text("summary failed validation"))
        .otherwise(or_text("artifact missing"))
    )
    return runs.select(
        "repo_id", "domain", worker.alias("runtime_status"),
        F.upper(F.replace(worker, F.lit("-"), F.lit(" "))).alias("status_label"), detail.alias("detail"),
    )


def final_tone(health_rows: DataFrame) -> DataFrame:
    h = F.col("overall_health")
    return health_rows.select(
        "repo_id",
        lookup(h, {k: v[0] for k, v in R.TONES.items()}, "watch").alias("state_tone"),
        lookup(h, {k: v[1] for k, v in R.TONES.items()}, R.TONES["watch"][1]).alias("state_label"),
    )


def compact_excerpt(text: Column, limit: int = 320) -> Column:
    """First three prose lines outside fences, headings and tables, cut with an ellipsis."""
    start = F.struct(F.lit(False).alias("fence"), strings([]).alias("kept"))

    def step(acc: Column, raw: Column) -> Column:
        s = F.trim(F.regexp_replace(raw, r"\s+", " "))
        fence = s.startswith("```")
        skip = fence | acc["fence"] | (s == "") | s.startswith("#") | s.startswith("|") | (F.size(acc["kept"]) >= 3)
        body = F.trim(F.when(s.startswith("- "), F.substring(s, F.lit(3), F.length(s))).otherwise(s))
        return F.struct(
            F.when(fence, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
            F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(body))).alias("kept"),
        )

    joined = F.aggregate(line_array(text), start, step, lambda acc: F.trim(F.array_join(acc["kept"], " ")))
    return F.when(F.length(joined) <= limit, joined).otherwise(F.concat(F.rtrim(F.substring(joined, 1, limit - 1)), F.lit("…")))


def bucket_of(domain: Column, verdict: Column) -> Column:
    """Roll-up bucket of a verdict; null when the contract does not know it."""
    return lookup(F.concat_ws("/", domain, verdict), {f"{d}/{v}": b for d, m in R.VERDICT_BUCKETS.items() for v, b in m.items()})
