"""API surfaces: evidence rows, candidates, homes, surface ids, findings, verdict."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import fold, guard, jvm, matches
from repoaudit.functions.text import collapse_snippet, line_array
from repoaudit.operators.manifests import manifest_deps
from repoaudit.operators.rule_index import RULES, matched_lines
from repoaudit.rules import api_surfaces as R
from repoaudit.session import stage
from repoaudit.sources.corpus import select_surface

KEY = ["repo_id", "provider", "wrapper", "family"]
EVIDENCE = [
    "repo_id", "path", "line", "ord", "snippet", "label", "kind", "strength", "source", "language", "provider", "wrapper",
    "family", "sdk", "version_hint", "model_hint", "base_url_hint",
]


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.ALIASES, "name string, provider string, wrapper string, family string, sdk string")


def language(path: Column) -> Column:
    return F.coalesce(P.application_language(path), F.lit("unknown"))


def manifest_evidence(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Declared packages known to the alias table; an equi join, its small side sized by the planner."""
    deps = manifest_deps(select_surface(files, "api-surfaces")).withColumn("key", F.lower(F.trim("name")))
    j = deps.join(aliases.withColumnRenamed("name", "key"), "key")
    package = F.col("manifest") == "package"
    prefix = F.when(package, "manifest-").when(F.col("manifest") == "project", "pyproject-").otherwise("requirements-")
    entry = F.when(package, F.concat("section", F.lit(": "), "name", F.lit(": "), "spec")).otherwise(F.col("spec"))
    null = F.lit(None).cast("string")
    return j.select(
        "repo_id", "path", "line", F.col("pos").alias("ord"), collapse_snippet(entry).alias("snippet"),
        F.concat(prefix, F.when(package, F.col("name")).otherwise(F.col("key"))).alias("label"),
        F.lit("manifest-package").alias("kind"), F.when(F.col("provider").isNotNull(), "strong").otherwise("medium").alias("strength"),
        F.lit("manifest").alias("source"), language(F.col("path")).alias("language"), "provider", "wrapper", "family", "sdk",
        F.when(package, F.concat("name", F.lit("@"), "spec")).otherwise(F.col("spec")).alias("version_hint"),
        null.alias("model_hint"), null.alias("base_url_hint"),
    )


def line_evidence(files: DataFrame) -> DataFrame:
    """Evidence of every line rule in one pass; lines are cut only where a rule's literal occurs."""
    src = select_surface(files, "api-surfaces").withColumn("low", fold(F.col("text")))
    low = F.col("low")
    patterns = [r.pattern for r in R.LINE_RULES] + [R.ENV_PATTERN]
    gates = [guard(low, p) for p in patterns]
    wanted = reduce(or_, [g for g in gates if g is not None]) if all(g is not None for g in gates) else F.lit(True)
    lines = F.transform(line_array(F.col("text")), lambda s, i: F.struct((i + 1).alias("n"), s.alias("s")))
    any_rule = "|".join(f"(?:{p})" for p in patterns)
    # the guard sits inside the generator: as a filter it would be pushed below the folding of
    # the text and fold it once per literal
    none = F.array().cast("array<struct<n: int, s: string>>")
    kept = F.when(wanted, F.filter(lines, lambda x: matches(x["s"], any_rule))).otherwise(none)
    hit_lines = src.select("repo_id", "path", F.explode(kept).alias("x"))
    line = F.col("x.s")
    empty = F.array().cast(HITS)

    def hits(i: int, r: R.SurfaceRule) -> Column:
        if r.every:
            found = F.regexp_extract_all(line, F.lit(jvm(r.pattern)), F.lit(0))
            return F.transform(found, lambda m: F.struct(F.lit(i).alias("rule"), m.alias("value")))
        value = collapse_snippet(line) if r.hint else F.lit(None).cast("string")
        return F.when(matches(line, r.pattern), F.array(F.struct(F.lit(i).alias("rule"), value.alias("value")))).otherwise(empty)

    envs = F.transform(
        F.regexp_extract_all(line, F.lit(R.ENV_PATTERN), F.lit(0)),
        lambda m: F.struct((P.lookup(m, ENV_INDEX).cast("int") + len(R.LINE_RULES)).alias("rule"), m.alias("value")),
    )
    found = F.concat(*[hits(i, r) for i, r in enumerate(R.LINE_RULES)], envs)
    spread = hit_lines.select("*", F.posexplode(found).alias("pos", "e"))
    # rule attributes are looked up by position after the hits are known
    rows = spread.withColumn("r", F.element_at(rule_array(), F.col("e.rule") + 1))
    return described(rows.select("repo_id", "path", F.col("x.n").alias("line_no"), line.alias("line"), F.col("pos").alias("ord"), F.col("e.value").alias("value"), "r.*"))


def described(rows: DataFrame) -> DataFrame:
    """Evidence rows of matched lines with their rule: where a line stands decides how strong it is."""
    path, line, sfx = F.col("path"), F.col("line"), P.suffix(F.col("path"))
    comment = F.when(sfx.isin(".py", ".pyi"), line.rlike(r"^\s*#")).when(
        sfx.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), line.rlike(r"^\s*(?://|/\*|\*)")
    )
    weak = sfx.isin(R.DOCS) | F.coalesce(comment, F.lit(False))
    hint = lambda name: F.when(F.col("hint") == name, F.col("value"))
    return rows.select(
        "repo_id", "path", F.col("line_no").alias("line"), "ord", collapse_snippet(line).alias("snippet"),
        "label", "kind", F.when(weak, "weak").otherwise(F.col("strength")).alias("strength"),
        F.when(weak, "docs").when(sfx.isin(R.CODE), "code").otherwise("config").alias("source"),
        language(path).alias("language"), "provider", "wrapper", "family", "sdk",
        F.lit(None).cast("string").alias("version_hint"), hint("model").alias("model_hint"), hint("base_url").alias("base_url_hint"),
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """The built-in rules as rows; callers add their own with higher numbers, or read a table of their own."""
    rows = [
        (i, r.label, R.TABLE_PATTERNS.get(r.label, r.pattern), r.kind, r.strength, r.provider, r.wrapper, r.family, r.sdk, r.every, r.hint)
        for i, r in enumerate([*R.LINE_RULES, *ENV_RULES])
    ]
    return spark.createDataFrame(rows, RULES)


def table_evidence(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Evidence of the rules of a table; a row added to it gives evidence without a change of code."""
    found = matched_lines(select_surface(files, "api-surfaces"), rules)
    value = F.when(F.col("every"), F.col("value")).when(F.col("hint").isNotNull(), collapse_snippet(F.col("line")))
    order = F.row_number().over(Window.partitionBy("repo_id", "path", "line_no").orderBy("ord", "nth"))  # matches of one line
    return described(found.withColumn("value", value).withColumn("ord", order - 1))


HITS = "array<struct<rule: int, value: string>>"
ENV_RULES = [r for r in R.RULES if r.kind == "env"]
ENV_INDEX = {r.label[4:]: str(i) for i, r in enumerate(ENV_RULES)}


def rule_array() -> Column:
    """The rule table as one literal array."""
    fields = ("label", "kind", "strength", "provider", "wrapper", "family", "sdk", "hint")
    lit = lambda v: f"'{v}'" if v is not None else "CAST(NULL AS STRING)"
    structs = ["named_struct(" + ", ".join(f"'{f}', {lit(getattr(r, f))}" for f in fields) + ")" for r in [*R.LINE_RULES, *ENV_RULES]]
    return F.expr("array(" + ", ".join(structs) + ")")


def collect(files: DataFrame, aliases: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Evidence written once: candidates, quotes and hints all read the narrow rows, not the texts.

    ``rules`` takes the place of the built-in rules (see ``rule_table``), ``aliases`` adds declared packages.
    """
    rows = (line_evidence(files) if rules is None else table_evidence(files, rules)).select(*EVIDENCE)
    if aliases is not None:
        rows = manifest_evidence(files, aliases).select(*EVIDENCE).unionByName(rows)
    return stage(rows, "api-evidence")


def order_key() -> Column:
    """Order of evidence: path, line, manifest before lines, rule order."""
    return F.struct("path", F.when(F.col("source") == "manifest", 0).otherwise(1).alias("late"), "line", "ord")


def keyed(ev: DataFrame) -> DataFrame:
    """Evidence that may form surfaces, with blank keys made comparable."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("provider", "wrapper")}
    return ev.where(F.col("source").isin("manifest", "code", "config")).withColumns(blank).withColumn("at", order_key())


def candidates(ev: DataFrame) -> DataFrame:
    """One row per repository and provider|wrapper|family.

    The key fixes provider, wrapper and family; language and SDK are modes with the first
    occurrence breaking ties. A repository has at most as many rows as the rule table has
    distinct keys.
    """
    # one count for each language and SDK of a key, then one row a key: the rule table bounds what meets there
    parts = keyed(ev).groupBy(*KEY, "language", "sdk").agg(
        F.min("at").alias("at"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("strength") == "strong").alias("strong"),
        F.bool_or(F.col("kind") == "manifest-package").alias("manifest"),
        F.bool_or(F.col("kind") == "base-url").alias("host"),
    )
    rows = parts.groupBy(*KEY).agg(
        F.min("at").alias("first"),
        F.sum("n").alias("n"),
        F.sum("strong").alias("strong"),
        F.bool_or("manifest").alias("manifest"),
        F.bool_or("host").alias("host"),
        F.collect_list(F.struct("language", "sdk", "n", "at")).alias("parts"),
    )

    def mode(field: str) -> Column:
        """The value with the most evidence, the earliest of equals."""
        having = lambda v: F.filter("parts", lambda x: x[field] == v)
        total = lambda v: F.aggregate(having(v), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        values = F.filter(F.array_distinct(F.transform("parts", lambda x: x[field])), lambda v: v.isNotNull())
        ranked = F.transform(
            values, lambda v: F.struct((-total(v)).alias("k"), F.array_min(F.transform(having(v), lambda x: x["at"])).alias("at"), v.alias("v"))
        )
        return F.array_min(ranked)["v"]

    rows = rows.withColumns({"language": mode("language"), "primary_sdk": mode("sdk")})
    named = F.col("provider") != ""
    level = (
        F.when(named & (F.col("strong") > 0), "provider-resolved")
        .when(F.col("wrapper") != "", "wrapper-resolved")
        .when(F.col("family") != "unknown", "family-resolved")
        .otherwise("ambiguous")
    )
    score = F.least("strong", F.lit(2)) + F.col("manifest").cast("int") + F.col("host").cast("int")
    return rows.select(
        *KEY, "first", "n", level.alias("level"),
        F.when(score >= 3, "high").when(score >= 2, "medium").otherwise("low").alias("confidence"),
        "language", "primary_sdk",
    )


RANK = {"high": 0, "medium": 1, "low": 2}
LOOSE = ("custom-http-llm", "unknown")
WEAK, FIRM = ("family-resolved", "ambiguous"), ("provider-resolved", "wrapper-resolved")
SAME = ["repo_id", "own_provider", "wrapper", "family", "level"]


def classes(cands: DataFrame) -> DataFrame:
    """Candidates with the number of their class; a class is what is alike once unresolved providers are left out.

    Classes are numbered by their first evidence. A repository has no more of them than the rule table has keys.
    """
    own = cands.withColumn("own_provider", F.when(F.col("level") == "provider-resolved", F.col("provider")).otherwise(""))
    starts = own.groupBy(*SAME).agg(F.min("first").alias("start"))
    numbers = starts.withColumn("class", F.row_number().over(Window.partitionBy("repo_id").orderBy("start", *SAME[1:])))
    return own.join(numbers.drop("start"), SAME)


def homes(members: DataFrame, ev: DataFrame) -> DataFrame:
    """``repo_id, class, home, turn``: the class that each class ends up in, itself where it stands alone.

    A weak class joins the first firm one of its family, or a generic wrapper, or, where its own family says little,
    one that shares a file with it. What it brings counts from then on: a firm class with a vague family takes the
    joining one's, and covers its files. In each round the first weak class of every repository that has a home joins
    it, until none has; then what is left of vague families joins the first telling family-level class that shares a
    file. A repository has no more rounds than weak classes, which the rule table bounds. Every round is a join by
    repository over classes, and its outcome a table in the shared folder; files meet once, before the first round.
    """
    keys = ["repo_id", "class"]
    whole = members.select(*keys, "level", "family").distinct()
    files = keyed(ev).join(members.select(*KEY, "class"), KEY).select("repo_id", "path", "class").distinct()
    met = files.join(files.withColumnRenamed("class", "other"), ["repo_id", "path"]).select(*keys, "other")
    met = stage(met.where(F.col("class") != F.col("other")).distinct(), "classes-that-meet")
    state = stage(whole.withColumn("home", F.col("class")).withColumn("turn", F.lit(0)), "class-homes")
    loose = F.col("family").isin(*LOOSE)

    def pairs(state: DataFrame, own: Column, to: Column) -> DataFrame:
        """Two classes of a repository that still stand alone, and whether files of the one are files of the other by now."""
        alone = state.where("home = class")
        other = alone.select("repo_id", *(F.col(c).alias(f"to_{c}") for c in ("class", "level", "family")))
        covered = met.join(state.select("repo_id", F.col("class").alias("other"), F.col("home").alias("to_class")), ["repo_id", "other"])
        meets = covered.select(*keys, "to_class").distinct().withColumn("meets", F.lit(True))
        both = alone.where(own).join(other.where(to), "repo_id").where("class <> to_class")
        return both.join(meets, [*keys, "to_class"], "left").fillna(False)

    def moved(state: DataFrame, steps: DataFrame, turn: Column) -> DataFrame:
        joined = state.join(steps.withColumnRenamed("class", "from"), "repo_id", "left")
        this = F.col("class").eqNullSafe(F.col("from"))
        takes = F.col("class").eqNullSafe(F.col("to_class")) & F.col("family").isin(*R.VAGUE) & ~F.col("brings").isin(*R.VAGUE)
        return joined.select(
            *keys, "level",
            F.when(takes, F.col("brings")).otherwise(F.col("family")).alias("family"),
            F.when(this, F.col("to_class")).otherwise(F.col("home")).alias("home"),
            F.when(this, turn).otherwise(F.col("turn")).alias("turn"),
        )

    first = F.min(F.struct("class", "to_class", F.col("family").alias("brings"))).alias("m")
    near = (F.col("to_family") == F.col("family")) | (F.col("to_family") == "generic-wrapper") | (loose & F.col("meets"))
    turn = 0
    while True:
        turn += 1
        found = pairs(state, F.col("level").isin(*WEAK), F.col("to_level").isin(*FIRM)).where(near)
        steps = stage(found.groupBy("repo_id").agg(first).select("repo_id", "m.*"), "class-steps")
        if not steps.limit(1).count():
            break
        state = stage(moved(state, steps, F.lit(turn)), "class-homes")
    peers = pairs(state, (F.col("level") == "family-resolved") & loose, (F.col("to_level") == "family-resolved") & ~F.col("to_family").isin(*LOOSE))
    last = peers.where("meets").groupBy(*keys).agg(F.min("to_class").alias("to"))
    return state.join(last, keys, "left").select(
        *keys, F.coalesce("to", "home").alias("home"), F.when(F.col("to").isNotNull(), turn).otherwise(F.col("turn")).alias("turn")
    )


def surfaces(cands: DataFrame, ev: DataFrame) -> DataFrame:
    """Candidate key to final surface, with the surface's attributes.

    The home's own values count first, then those of the classes that joined it in the order in which they did; a
    value that says nothing gives way to the next.
    """
    members = stage(classes(cands), "surface-classes")
    placed = members.join(homes(members, ev), ["repo_id", "class"]).withColumn("turn", F.struct("turn", "class", "first"))

    def telling(value: str, says_nothing: Column) -> Column:
        """The first value that says something, else the home's."""
        return F.coalesce(F.min_by(value, F.when(~says_nothing, F.col("turn"))), F.min_by(value, "turn"))

    rank = P.lookup(F.col("confidence"), {k: str(v) for k, v in RANK.items()}).cast("int")
    rows = placed.groupBy("repo_id", "home").agg(
        telling("family", F.col("family").isin(*R.VAGUE)).alias("surface_family"),
        telling("own_provider", F.col("own_provider") == "").alias("surface_provider"),
        telling("wrapper", F.col("wrapper") == "").alias("surface_wrapper"),
        F.min_by("level", "turn").alias("level"),
        F.min_by("confidence", rank).alias("confidence"),
        telling("language", F.col("language") == "unknown").alias("language"),
        telling("primary_sdk", F.col("primary_sdk").isin("unknown", "generic-wrapper")).alias("primary_sdk"),
    )
    level = P.lookup(F.col("level"), {k: str(v) for k, v in R.LEVEL_RANK.items()}).cast("int")
    order = Window.partitionBy("repo_id").orderBy(level, "surface_family", "primary_sdk", "home")
    numbered = rows.withColumn("surface", F.row_number().over(order))
    return placed.select(*KEY, "home").join(numbered, ["repo_id", "home"]).drop("home")


def surface_rows(resolved: DataFrame) -> DataFrame:
    """One row per final surface with its id."""
    cols = ["surface_family", "surface_provider", "surface_wrapper", "level", "confidence", "language", "primary_sdk"]
    return resolved.select("repo_id", "surface", *cols).distinct().withColumn("surface_id", F.format_string("surface-%03d", "surface"))


def hints(ev: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct version, model and host hints per surface, as rows: a list could grow with the data."""
    k = keyed(ev).join(resolved.select(*KEY, "surface"), KEY)
    pairs = F.array(*[F.struct(F.lit(h).alias("hint"), F.col(f"{h}_hint").alias("value")) for h in ("version", "model", "base_url")])
    return (
        k.select("repo_id", "surface", "at", F.explode(pairs).alias("h"))
        .where("h.value is not null")
        .groupBy("repo_id", "surface", "h.hint", "h.value")
        .agg(F.min("at").alias("first"))
        .select("repo_id", "surface", "hint", "value")
    )


def detect(resolved: DataFrame, ev: DataFrame) -> DataFrame:
    """Ambiguity, gateway and legacy findings. Legacy evidence maps to the last surface that holds it."""
    s = surface_rows(resolved)
    gaps = s.select(
        "repo_id", "surface_id",
        F.when(F.col("level") == "ambiguous", "provider-ambiguous")
        .when((F.col("level") == "wrapper-resolved") & (F.col("surface_provider") == ""), "gateway-resolution-gap")
        .alias("kind"),
        F.lit(".").alias("path"), F.lit(0).alias("line"), F.lit("").alias("label"),
    ).where("kind is not null")
    own = keyed(ev).join(resolved.select(*KEY, "surface"), KEY)
    legacy = (
        own.groupBy("repo_id", "path", "line", "label")
        .agg(F.max("surface").alias("surface"), F.bool_or(F.col("kind") == "legacy-suspicion").alias("legacy"))
        .where("legacy")
        .join(s.select("repo_id", "surface", "surface_id"), ["repo_id", "surface"])
        .select("repo_id", "surface_id", F.lit("legacy-suspicion").alias("kind"), "path", "line", "label")
    )
    return gaps.unionByName(legacy).withColumn("severity", F.lit("low"))


def verdicts(repos: DataFrame, resolved: DataFrame) -> DataFrame:
    has = resolved.groupBy("repo_id").agg(F.countDistinct("surface").alias("surfaces"))
    rows = repos.select("repo_id").distinct().join(has, "repo_id", "left").fillna(0)
    return rows.withColumn("verdict", F.when(F.col("surfaces") == 0, "not-applicable").otherwise("triage"))


def merge_doc_evidence(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Union of document evidence, one row per (surface, library, source, status); existing rows win."""
    keys = ["repo_id", "surface_id", "library_id", "source_ref", "status"]
    both = existing.withColumn("ord", F.lit(0)).unionByName(added.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys + ["ord"]]
    first = both.groupBy(*keys).agg(F.min(F.struct("ord", *rest)).alias("w"))
    return first.select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest])


DOC_KEY = ["repo_id", "surface_id", "library_id", "source_ref"]


def evidence_as_of(doc_evidence: DataFrame, as_of, valid_days: int | None = None) -> DataFrame:
    """The last word of each source on a surface and library at a date, where it still holds.

    ``doc_evidence`` has ``checked_at`` (date) and ``status`` beside the keys; of two checks on one day the one that
    failed counts. Checks after the date, or ``valid_days`` and more before it, say nothing; a later failure takes an
    earlier success back. One aggregation, combined before the shuffle.
    """
    at = F.lit(as_of).cast("date")
    known = doc_evidence.where(F.col("checked_at") <= at)
    last = known.groupBy(*DOC_KEY).agg(F.max(F.struct("checked_at", (F.col("status") != "verified").alias("failed"), "status")).alias("w"))
    rows = last.select(*DOC_KEY, "w.status", "w.checked_at")
    return rows if valid_days is None else rows.where(F.date_diff(at, F.col("checked_at")) < valid_days)


def unknown_surfaces(doc_evidence: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Evidence rows that name a surface which the repository does not have."""
    return doc_evidence.join(surfaces.select("repo_id", "surface_id").distinct(), ["repo_id", "surface_id"], "left_anti")


def verified_verdicts(rows: DataFrame, doc_evidence: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Triage becomes verified where a document was verified for a surface that the repository has."""
    own = doc_evidence.where("status = 'verified'").join(surfaces.select("repo_id", "surface_id").distinct(), ["repo_id", "surface_id"], "left_semi")
    ok = own.select("repo_id").distinct().withColumn("ok", F.lit(True))
    verified = (F.col("verdict") == "triage") & F.coalesce("ok", F.lit(False))
    return rows.join(ok, "repo_id", "left").withColumn("verdict", F.when(verified, "verified").otherwise(F.col("verdict"))).drop("ok")
