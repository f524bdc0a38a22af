"""Document links: extraction, resolution, and checks against the file and anchor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.functions.regex import jvm, strip
from repoaudit.functions.text import line_of, slug
from repoaudit.session import stage
from repoaudit.sources.corpus import select_surface

# fixed values
MARKDOWN = [".md", ".mdx"]
HTML = [".html", ".htm"]
MARKDOWN_LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
HTML_LINK = r"(?i:(?:href|src)=[\"']([^\"']+)[\"'])"
HEADING = r"(?m)^#{1,6}\s+(.+?)\s*$"
EXTERNAL = r"^(?:https?://|mailto:|tel:)"
FALLBACKS = ["index.md", "README.md"]


def extract_links(files: DataFrame) -> DataFrame:
    """Every link target with its source file and the line of the target's first occurrence."""
    src = select_surface(files, "doc-links")
    text, sfx = F.col("text"), P.suffix(F.col("path"))
    none = P.strings([])
    md = F.when(sfx.isin(MARKDOWN), F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1))).otherwise(none)
    html = F.when(sfx.isin(HTML), F.regexp_extract_all(text, F.lit(HTML_LINK), F.lit(1))).otherwise(none)
    targets = F.transform(F.concat(md, html), lambda t: F.struct(t.alias("target"), line_of(text, t).alias("line")))
    return src.select("repo_id", F.col("path").alias("source"), F.posexplode(targets).alias("ord", "x")).select(
        "repo_id", "source", "ord", "x.target", "x.line"
    )


def resolve(links: DataFrame) -> DataFrame:
    """Local target path and anchor; external links give neither. A path leaving the tree is null and ``escapes``."""
    t = strip(F.col("target"))
    external = t.rlike(EXTERNAL)
    bare = F.substring_index(F.substring_index(t, "#", 1), "?", 1)
    anchor = F.when(t.contains("#"), F.substring(t, F.instr(t, "#") + 1, F.length(t)))
    local = F.when(bare == "", F.col("source")).otherwise(P.join_relative(P.parent(F.col("source")), bare))
    return links.select(
        "*",
        external.alias("external"),
        F.when(~external, local).alias("resolved"),
        F.when(~external & (anchor != ""), anchor).alias("anchor"),
        (~external & (bare != "") & local.isNull()).alias("escapes"),
    )


def anchors(files: DataFrame) -> DataFrame:
    """Distinct heading anchors per file."""
    heads = F.regexp_extract_all(F.col("text"), F.lit("(?d)" + HEADING), F.lit(1))
    names = F.array_distinct(F.transform(heads, heading_slug))
    return files.select("repo_id", "path", F.explode(names).alias("anchor"))


def heading_slug(heading: Column) -> Column:
    """Slug of the link checker: blanks to dashes first, then other characters out, dashes collapsed."""
    s = F.regexp_replace(F.lower(strip(heading)), jvm(r"\s+"), "-")
    s = F.regexp_replace(s, jvm(r"[^\w\-一-鿿]"), "")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), r"^-+|-+\z", "")


def check_links(files: DataFrame) -> DataFrame:
    """Broken local links with their reason.

    Each link offers up to three candidate paths (itself, two index files); they meet the
    file table in one equi join on (repo, path). Only keys of files take part, no texts.
    """
    # written once: three branches below read the narrow link rows instead of the texts
    links = stage(resolve(extract_links(files)), "links").where(~F.col("external"))
    path = F.col("resolved")
    bare = P.suffix(path) == ""
    fallback = F.when(bare, F.array(*[F.concat(path, F.lit("/" + n)) for n in FALLBACKS])).otherwise(P.strings([]))
    keyed = links.withColumn("link", F.struct("source", "ord"))
    options = keyed.select(
        "repo_id", "link", F.posexplode(F.concat(F.array(path), fallback)).alias("choice", "path")
    ).where("path is not null")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(P.parts(F.col("path")))), lambda n: F.array_join(F.slice(P.parts(F.col("path")), 1, n), "/")
    )
    # a directory exists when a file lies below it
    exists = files.select("repo_id", F.explode(parents).alias("path")).distinct()
    hit = (
        options.join(exists, ["repo_id", "path"])
        .groupBy("repo_id", "link")
        .agg(F.min(F.struct("choice", "path")).alias("h"))
        .select("repo_id", "link", F.col("h.path").alias("found"))
    )
    placed = keyed.join(hit, ["repo_id", "link"], "left")
    known = placed.where("found is not null")
    named = anchors(files)
    lost = known.where("anchor is not null").join(
        named, (known.repo_id == named.repo_id) & (known.found == named.path) & (known.anchor == named.anchor), "left_anti"
    )
    readable = files.select("repo_id", F.col("path").alias("found")).distinct()
    unreadable = lost.join(readable, ["repo_id", "found"], "left_anti").select(*lost.columns)
    cols = ["repo_id", "source", "ord", "target", "line"]
    return (
        placed.where("found is null").select(*cols, F.lit("missing-path").alias("reason"))
        .unionByName(unreadable.select(*cols, F.lit("anchor-target-unreadable").alias("reason")))
        .unionByName(
            lost.join(readable, ["repo_id", "found"], "left_semi").select(*cols, F.lit("missing-anchor").alias("reason"))
        )
    )


def escaping_links(files: DataFrame) -> DataFrame:
    """Links that leave their own tree."""
    return resolve(extract_links(files)).where("escapes").select("repo_id", "source", "target", "line")


def document_slug(heading: Column) -> Column:
    """Slug of the document contract check: no dash collapsing."""
    return slug(heading, collapse_dashes=False)
