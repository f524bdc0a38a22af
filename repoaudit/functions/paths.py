"""Path and file-name operators: column expressions over ``path``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoaudit.functions.regex import matches
from repoaudit.rules import surface as S
from repoaudit.rules.categories import TEST_FILE


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, or ''. A leading dot does not start a suffix."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    """Parent directory names, outermost first."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def parent(path: Column) -> Column:
    d = directories(path)
    return F.when(F.size(d) == 0, F.lit(".")).otherwise(F.array_join(d, "/"))


def strings(values) -> Column:
    """Literal array of strings, usable where the list may be empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed table by key; a literal map, so no join is planned."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def language(path: Column) -> Column:
    return lookup(suffix(path), S.LANGUAGE_BY_SUFFIX)


def application_language(path: Column) -> Column:
    return lookup(suffix(path), S.APPLICATION_LANGUAGE_BY_SUFFIX)


def is_doc(path: Column) -> Column:
    return suffix(path).isin(S.DOC_SUFFIXES)


def is_code_or_config(path: Column) -> Column:
    keep = [s for s in S.SURFACES["cleanup"]["suffixes"] if s not in S.DOC_SUFFIXES]
    return suffix(path).isin(keep)


def is_test(path: Column) -> Column:
    """Test file by marker directory or by file name."""
    return matches(F.concat(F.lit("/"), F.lower(path)), S.TEST_PATH)


def is_test_by_parts(path: Column) -> Column:
    """Second variant: a test directory anywhere, or a test-like file name."""
    return matches(path, TEST_FILE)


def is_generated(path: Column) -> Column:
    return F.arrays_overlap(parts(F.lower(path)), strings(S.GENERATED_PARTS))


def is_migration(path: Column) -> Column:
    return F.arrays_overlap(parts(F.lower(path)), strings(S.MIGRATION_PARTS))


def is_boundary(path: Column) -> Column:
    return matches(path, S.BOUNDARY_PATH)


def is_ci_config(path: Column) -> Column:
    return matches(path, S.CI_CONFIG_PATH)


def is_foreign_runtime(path: Column) -> Column:
    return matches(path, S.FOREIGN_RUNTIME_PATH)


def is_domain_file(path: Column) -> Column:
    return F.arrays_overlap(parts(F.lower(path)), strings(["domain", "domains"]))


def context_name(path: Column) -> Column:
    """Directory or file name right after the first context marker."""
    p = parts(F.lower(path))

    def after(marker: str) -> Column:
        at = F.array_position(p, F.lit(marker))
        return F.when(at > 0, F.try_element_at(p, (at + 1).cast("int")))

    return F.coalesce(*[after(m) for m in S.CONTEXT_MARKERS])


def is_entrypoint(path: Column) -> Column:
    return name(path).isin(S.ENTRYPOINT_NAMES)


def source_root(path: Column) -> Column:
    """Bucket of a source file: package directory, ``src``, or first directory of a code file."""
    p = parts(path)
    first = F.element_at(p, 1)
    nested = F.when(
        (F.size(p) >= 3) & (F.try_element_at(p, F.lit(3)) == "src"), F.array_join(F.slice(p, 1, 3), "/")
    ).when(F.size(p) >= 2, F.array_join(F.slice(p, 1, 2), "/"))
    return (
        F.when(first.isin(S.WORKSPACE_PARENTS) & (F.size(p) >= 2), nested)
        .when(first == "src", F.lit("src"))
        .when(first.isin(S.NON_SOURCE_ROOTS), F.lit(None).cast("string"))
        .when(suffix(path).isin(S.CODE), first)
    )


def python_package(path: Column) -> Column:
    """Candidate first-party package names of a Python file (array of one or two)."""
    p = parts(path)
    first = F.element_at(p, 1)
    second = F.when(
        first.isin("src", "app", "apps", "services", "packages") & (F.size(p) >= 2), F.try_element_at(p, F.lit(2))
    )
    top = F.when(~first.isin("scripts", "tests"), F.substring_index(first, ".", 1))
    both = F.array_compact(F.array(second, top))
    return F.array_distinct(F.filter(both, lambda x: matches(x, r"^[A-Za-z_]\w*\z")))


def path_markers(path: Column) -> Column:
    low = F.lower(path)
    return F.array_distinct(F.concat(parts(low), F.array(stem(low), suffix(low))))


def import_hits(imports: Column, prefixes: list[str]) -> Column:
    """True when an import equals a prefix or continues it with ``.`` or ``/``."""
    escaped = "|".join(p.replace(".", r"\.").replace("-", r"\-") for p in prefixes)
    return F.exists(imports, lambda m: F.lower(m).rlike(rf"^(?:{escaped})(?:[./]|\z)"))


def responsibility_tags(imports: Column, path: Column) -> Column:
    """Sorted tags whose import table or path-marker table is touched."""
    markers = path_markers(path)
    tags = []
    for tag in S.RESPONSIBILITY_IMPORTS:
        by_import = import_hits(imports, S.RESPONSIBILITY_IMPORTS[tag])
        by_path = F.arrays_overlap(markers, strings(S.RESPONSIBILITY_MARKERS[tag]))
        tags.append(F.when(by_import | by_path, F.lit(tag)))
    return F.array_sort(F.array_compact(F.array(*tags)))


def join_relative(base_dir: Column, target: Column) -> Column:
    """Join a relative target to a directory and normalise ``.`` and ``..``.

    Returns null when the target climbs above the repository root.
    """
    absolute = target.startswith("/")
    joined = F.when(absolute | (base_dir == "."), target).otherwise(F.concat_ws("/", base_dir, target))
    steps = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    empty = F.struct(strings([]).alias("kept"), F.lit(False).alias("escaped"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        kept = F.when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(
            F.concat(acc["kept"], F.array(s))
        )
        return F.struct(kept.alias("kept"), (acc["escaped"] | (up & (F.size(acc["kept"]) == 0))).alias("escaped"))

    done = F.aggregate(steps, empty, step)
    return F.when(~absolute & ~done["escaped"], F.array_join(done["kept"], "/"))
