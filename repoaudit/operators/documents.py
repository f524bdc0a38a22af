"""Document contracts: frontmatter, sections, cases, wording, links, packaging noise, copies and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.regex import jvm, matches, strip
from repoaudit.functions.text import line_array

# fixed values
FRONT_KEYS = ["name", "description"]
DESCRIPTION_PREFIXES = ["Audits ", "Orchestrates ", "Use "]
DESCRIPTION_MARK = "Use for"
DESCRIPTION_LIMIT = 1024
BODY_LIMIT = 500
KEBAB = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
CASE_LINE = r"^\s*(?:[-*]|\d+\.)\s+\S"
TIME_SENSITIVE = r"(?i:\b20\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+20\d{2}\b)"
NOISE_PATH = r"(?:^|/)__pycache__(?:/|\z)|\.pyc\z|(?:^|/)agents/README\.md\z"


def frontmatter(text: Column) -> Column:
    """Struct of the block between the leading ``---`` lines: opened, closed, fields map, body line count."""
    lines = line_array(text)
    opened = strip(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))) == "---"
    marks = F.filter(F.transform(lines, lambda x, i: F.when((strip(x) == "---") & (i > 0), i + 1)), lambda n: n.isNotNull())
    end = F.try_element_at(marks, F.lit(1))
    inner = F.filter(F.slice(lines, 2, F.greatest(end - 2, F.lit(0))), lambda s: strip(s) != "")
    pairs = F.transform(
        F.filter(inner, lambda s: s.contains(":")),
        lambda s: F.struct(strip(F.substring_index(s, ":", 1)).alias("key"), unquote(strip(F.substring(s, F.instr(s, ":") + 1, F.length(s)))).alias("value")),
    )
    known = F.filter(pairs, lambda p: p["key"].isin(FRONT_KEYS) & (p["value"] != ""))
    closed = opened & end.isNotNull()
    first_of = lambda k: F.try_element_at(F.transform(F.filter(known, lambda p: p["key"] == k), lambda p: p["value"]), F.lit(-1))
    return F.struct(
        opened.alias("opened"),
        F.coalesce(closed, F.lit(False)).alias("closed"),
        F.when(closed, first_of("name")).alias("name"),
        F.when(closed, first_of("description")).alias("description"),
        F.when(closed, F.size(F.filter(inner, lambda s: ~s.contains(":")))).otherwise(0).alias("bad_lines"),
        F.when(closed, F.size(lines) - end).otherwise(F.size(lines)).alias("body_lines"),
    )


def unquote(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & (
        (value.startswith("'") & value.endswith("'")) | (value.startswith('"') & value.endswith('"'))
    )
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def section(text: Column, header: str) -> Column:
    """Text from ``## header`` (any case) up to the next second-level heading; '' when absent."""
    mark = f"## {header}".lower()
    low = F.lower(text)
    start = F.instr(low, mark)
    rest = F.substring(text, start + len(mark), F.length(text))
    body = F.regexp_extract(rest, r"(?ds)\A(.*?)(?=(?m:^##\s)|\z)", 1)
    return F.when(start > 0, F.concat(F.substring(text, start, F.lit(len(mark))), body)).otherwise("")


def case_count(body: Column) -> Column:
    """Lines that look like one concrete case of a list."""
    return F.size(F.filter(line_array(body), lambda s: matches(s, CASE_LINE)))


def validate_documents(docs: DataFrame, sections: list[str] = (), required: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    """Violations of the document contract, all of them, each with the ordinal of its rule.

    ``docs``: doc_set, path, text; a document set is one directory, its name is the expected ``name``.
    """
    rows = docs.withColumn("fm", frontmatter(F.col("text")))
    fm, text = F.col("fm"), F.col("text")
    name, description = fm["name"], fm["description"]
    checks: list[tuple[Column, Column]] = [
        (~fm["opened"], F.lit("must start with frontmatter delimiter")),
        (fm["opened"] & ~fm["closed"], F.lit("frontmatter is not closed")),
        (fm["bad_lines"] > 0, F.lit("frontmatter lines must use key: value format")),
        (fm["closed"] & description.isNull(), F.lit("missing required frontmatter key description")),
        (fm["closed"] & name.isNull(), F.lit("missing required frontmatter key name")),
        (name.isNotNull() & (name != F.col("doc_set")), F.concat(F.lit("name "), name, F.lit(" must match directory name "), F.col("doc_set"))),
        (name.isNotNull() & ~matches(name, KEBAB), F.lit("name must be kebab-case")),
        (fm["body_lines"] >= BODY_LIMIT, F.lit(f"body must stay under {BODY_LIMIT} lines")),
        (F.length(description) > DESCRIPTION_LIMIT, F.lit(f"description exceeds {DESCRIPTION_LIMIT} characters")),
        (~matches(description, "^(?:" + "|".join(DESCRIPTION_PREFIXES) + ")"), F.lit("description must start with an allowed prefix")),
        (~F.concat(F.lit(" "), description, F.lit(" ")).contains(f" {DESCRIPTION_MARK} "), F.lit("description must contain its trigger phrase")),
        (matches(text, TIME_SENSITIVE), F.lit("time-sensitive literal")),
    ]
    for header in sections:
        part = section(text, header)
        checks.append((part == "", F.lit(f"missing required section ## {header}")))
        checks.append(((part != "") & (case_count(part) < 1), F.lit(f"section ## {header} must contain at least one concrete case")))
    checks += [(~text.contains(p), F.lit(f"required phrase missing: {p}")) for p in required]
    checks += [(text.contains(p), F.lit(f"forbidden phrase present: {p}")) for p in forbidden]
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(i).alias("ord"), m.alias("message"))) for i, (c, m) in enumerate(checks)])
    )
    return rows.select("doc_set", "path", F.explode(found).alias("v")).select("doc_set", "path", "v.*")


def packaging_noise(files: DataFrame) -> DataFrame:
    """Cache directories, compiled files and placeholder documents that should not be shipped."""
    path = F.col("path")
    kind = (
        F.when(matches(path, r"(?:^|/)__pycache__(?:/|\z)"), "cache-directory")
        .when(path.endswith(".pyc"), "compiled-file")
        .otherwise("placeholder-document")
    )
    return files.where(matches(path, NOISE_PATH)).select("repo_id", "path", kind.alias("kind"))


def diff_trees(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Paths missing from ``b``, extra in ``b``, or with other content. Digests cross the shuffle, not contents."""
    digest = lambda df, out: df.select(*keys, F.sha2(F.col("content").cast("binary"), 256).alias(out))
    j = digest(a, "da").join(digest(b, "db"), keys, "full_outer")
    state = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").when(F.col("da") != F.col("db"), "mismatch")
    return j.select(*keys, state.alias("state")).where("state is not null")


def derived_content(name: Column, body: Column) -> Column:
    """Expected text of a generated copy: a marker line, then the source with one final line break."""
    return F.concat(
        F.lit("<!-- GENERATED FILE. Edit shared/"), name, F.lit(". -->\n\n"), F.regexp_replace(body, jvm(r"\s+\z"), ""), F.lit("\n")
    )


def diff_derived(canonical: DataFrame, copies: DataFrame) -> DataFrame:
    """Generated copies that are absent or out of step. ``canonical``: name, text; ``copies``: name, path, text."""
    want = canonical.select("name", F.sha2(derived_content(F.col("name"), F.col("text")).cast("binary"), 256).alias("want"))
    have = copies.select("name", "path", F.sha2(F.col("text").cast("binary"), 256).alias("have"))
    j = want.join(have, "name", "left")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "out-of-sync")
    return j.select("name", F.coalesce("path", F.lit("")).alias("path"), state.alias("state")).where("state is not null")


def set_drift(actual: DataFrame, managed: DataFrame, exempt: DataFrame, key: str = "name") -> DataFrame:
    """Names in use but neither managed nor exempt, and managed or exempt names not in use."""
    pick = lambda df, reason: df.select(key, F.lit(reason).alias("reason"))
    unmanaged = actual.select(key).distinct().join(managed, key, "left_anti").join(exempt, key, "left_anti")
    return (
        pick(unmanaged, "unmanaged")
        .unionByName(pick(managed.select(key).distinct().join(actual, key, "left_anti"), "unknown-managed"))
        .unionByName(pick(exempt.select(key).distinct().join(actual, key, "left_anti"), "unknown-exempt"))
    )


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def shared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on both sides."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")
