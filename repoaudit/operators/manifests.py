"""Declared dependencies of package, project and requirement manifests as rows."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import matches, strip
from repoaudit.functions.text import line_array
from repoaudit.rules.api_surfaces import PACKAGE_SECTIONS, REQUIREMENT_NAME, REQUIREMENTS

DEPS = "repo_id string, path string, manifest string, section string, name string, spec string, line int, pos int"


def package_deps(files: DataFrame) -> DataFrame:
    """``package.json`` sections; invalid JSON gives no rows."""
    schema = "struct<" + ", ".join(f"{s}: map<string, string>" for s in PACKAGE_SECTIONS) + ">"
    parsed = files.where(P.name(F.col("path")) == "package.json").select("repo_id", "path", F.from_json("text", schema).alias("j"))
    pairs = F.flatten(F.array_compact(F.array(*[_section(s) for s in PACKAGE_SECTIONS])))
    return parsed.select("repo_id", "path", F.posexplode(pairs).alias("pos", "d")).select(
        "repo_id", "path", F.lit("package").alias("manifest"), "d.section", "d.name", "d.spec", F.lit(1).alias("line"), "pos"
    )


def _section(section: str):
    return F.transform(
        F.map_entries(F.col(f"j.{section}")),
        lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("spec")),
    )


def requirement_deps(files: DataFrame) -> DataFrame:
    """Requirement lines with their line numbers."""
    lines = F.transform(line_array(F.col("text")), lambda s, i: F.struct((i + 1).alias("line"), strip(s).alias("s")))
    kept = F.filter(lines, lambda x: (x["s"] != "") & ~x["s"].startswith("#") & ~x["s"].startswith("-r ") & matches(x["s"], REQUIREMENT_NAME))
    rows = files.where(P.name(F.col("path")).rlike(REQUIREMENTS)).select("repo_id", "path", F.posexplode(kept).alias("pos", "d"))
    return rows.select(
        "repo_id", "path", F.lit("requirements").alias("manifest"), F.lit("").alias("section"),
        F.regexp_extract("d.s", REQUIREMENT_NAME, 1).alias("name"), F.col("d.s").alias("spec"), "d.line", "pos",
    )


def project_entries(text: str) -> list[tuple[str, str]]:
    """(section, entry) pairs of a project file: standard, optional, and tool-specific tables."""
    try:
        data = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError):
        return []
    table = lambda d, k: d.get(k) if isinstance(d, dict) and isinstance(d.get(k), dict) else {}
    project, poetry = table(data, "project"), table(table(data, "tool"), "poetry")
    out = [("project", str(e)) for e in project.get("dependencies", []) or [] if isinstance(project.get("dependencies"), list)]
    for extra in table(project, "optional-dependencies").values():
        out += [("optional", str(e)) for e in extra] if isinstance(extra, list) else []
    spec = lambda n, v: n + (v if isinstance(v, str) else "")
    out += [("poetry", spec(n, v)) for n, v in table(poetry, "dependencies").items() if n != "python"]
    for group in table(poetry, "group").values():
        out += [("group", spec(n, v)) for n, v in table(group, "dependencies").items()]
    return out


def project_deps(files: DataFrame) -> DataFrame:
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = re.compile(REQUIREMENT_NAME)
        for b in batches:
            rows = [
                (r, p, "project", s, named.match(e.strip()).group(1), e.strip(), 1, i)
                for r, p, t in zip(b["repo_id"], b["path"], b["text"])
                for i, (s, e) in enumerate(project_entries(t))
                if named.match(e.strip())
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEPS.split(", ")])

    src = files.where(P.name(F.col("path")) == "pyproject.toml").select("repo_id", "path", "text")
    return src.mapInPandas(job, DEPS)


def manifest_deps(files: DataFrame) -> DataFrame:
    """All declared dependencies. Manifests are picked by name first, so few texts are read."""
    return package_deps(files).unionByName(project_deps(files)).unionByName(requirement_deps(files))
