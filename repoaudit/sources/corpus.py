"""The ``files`` table: reading trees, choosing an audit's surface, counting what was left out."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count, islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoaudit.functions import paths as P
from repoaudit.rules.surface import SURFACES
from repoaudit.schemas import FILES
from repoaudit.session import spread, stage


def read_corpus(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Read checkouts below ``root`` into the ``files`` schema, files of any size.

    The first ``repo_depth`` path components below ``root`` name the repository. Spark's own
    file sources skip names that start with ``.`` or ``_``, which source trees are full of, so
    the tree is listed and read by tasks through Arrow file systems (local, HDFS, object
    stores): directories are expanded level by level, names are shuffled by path, and only
    then are contents read, so that one huge repository is read by many tasks.
    """
    level = spark.createDataFrame([("", root.rstrip("/"))], "repo_id string, place string")
    for _ in range(repo_depth):
        level = level.mapInPandas(list_repositories, "repo_id string, place string").repartition("repo_id")
    level, files = level.withColumn("path", F.lit("")), []
    while True:  # one round for each level of directories
        found = stage(level.repartition("place").mapInPandas(list_entries, ENTRIES), "listing")
        files.append(found.where("is_file").drop("is_file"))
        level = found.where("NOT is_file").select("repo_id", "place", "path")
        if not level.limit(1).count():
            break
    return reduce(DataFrame.unionAll, files).repartition("repo_id", "path").mapInPandas(read_files, FILES)


ENTRIES = "repo_id string, path string, place string, size_bytes long, is_file boolean"


def list_repositories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for repo, place in zip(batch["repo_id"], batch["place"]):
            fs, base = open_place(place)
            found = [i for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
            names = [i.base_name for i in found]
            yield pd.DataFrame({"repo_id": [f"{repo}/{n}".lstrip("/") for n in names], "place": [f"{place}/{n}" for n in names]})


def list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names and sizes in each directory; a directory is one row of work."""
    for batch in batches:
        for repo, place, path in zip(batch["repo_id"], batch["place"], batch["path"]):
            fs, base = open_place(place)
            found = [i for i in fs.get_file_info(pafs.FileSelector(base)) if i.type != pafs.FileType.NotFound]
            yield pd.DataFrame(
                {
                    "repo_id": repo,
                    "path": [f"{path}/{i.base_name}".lstrip("/") for i in found],
                    "place": [f"{place}/{i.base_name}" for i in found],
                    "size_bytes": [i.size or 0 for i in found],
                    "is_file": [i.is_file for i in found],
                }
            )


def read_files(batches: Iterator[pd.DataFrame], chunk: int = 64) -> Iterator[pd.DataFrame]:
    """Texts in small chunks, so that a batch of large files stays small; binary files are dropped."""
    for batch in batches:
        for start in range(0, len(batch), chunk):
            part = batch.iloc[start : start + chunk]
            rows = []
            for r in part.itertuples():
                fs, base = open_place(r.place)
                text = decode_text(fs.open_input_file(base).read())
                if text is not None:
                    rows.append((r.repo_id, r.path, text, r.size_bytes))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "text", "size_bytes"])


def write_tree(rows: DataFrame, root: str) -> None:
    """Write ``repo_id, path, text`` rows as files ``<root>/<repo_id>/<path>``, by tasks, through Arrow file systems.

    A file is written whole under its final name, so a task that runs again writes the same bytes again. A null text
    is an empty file. Names are taken as they are; two rows with one name leave one of the two.
    """
    out = rows.select("repo_id", "path", "text").withColumn("root", F.lit(root.rstrip("/")))
    out.mapInPandas(write_files, "written long").write.format("noop").mode("overwrite").save()


def write_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made = set()
    for batch in batches:
        for r in batch.itertuples():
            fs, place = open_place(f"{r.root}/{r.repo_id}/{r.path}")
            folder = place.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(place) as f:
                f.write((r.text or "").encode())
        yield pd.DataFrame({"written": [len(batch)]})


def write_archives(rows: DataFrame, root: str) -> None:
    """The tree of ``write_tree`` as members ``<repo_id>/<path>`` of compressed tar archives below ``root``.

    For trees of many small files, each of which would take a block of the disk and another one for its directory. A
    task writes an archive for every ``pack_files.members`` rows, named by its partition, so that a task that runs again
    replaces its own archives.
    """
    out = rows.select("repo_id", "path", "text").withColumn("root", F.lit(root.rstrip("/")))
    out.mapInArrow(pack_files, "written long").write.format("noop").mode("overwrite").save()


def pack_files(batches: Iterator[pa.RecordBatch], members: int = 10_000) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
    for n in count():
        first = next(rows, None)
        if first is None:
            return
        fs, place = open_place(first[3])
        fs.create_dir(place, recursive=True)
        written = 0
        with (
            fs.open_output_stream(f"{place}/part-{part:05d}-{n:05d}.tar.gz", compression=None) as f,
            tarfile.open(fileobj=f, mode="w|gz", compresslevel=1, format=tarfile.GNU_FORMAT, encoding="utf-8") as tar,
        ):
            for repo, path, text, _ in chain([first], islice(rows, members - 1)):
                data = (text or "").encode()
                info = tarfile.TarInfo(f"{repo}/{path}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                written += 1
        yield pa.RecordBatch.from_pydict({"written": [written]})


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_archives`` wrote, as (repo_id, path, content); an archive is read by one task as a stream.

    The planner knows the size of the list of archives only and would broadcast what they hold by it, so a join of the
    members is a sort-merge join.
    """
    top = spark.createDataFrame([("", root.rstrip("/"), "")], "repo_id string, place string, path string")
    listed = top.mapInPandas(list_entries, ENTRIES).where("is_file").select("place")
    return listed.repartition(spread(spark), "place").mapInArrow(unpack_files, "repo_id string, path string, content binary").hint("merge")


def unpack_files(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Members in batches of ``chunk`` bytes."""
    names = ["repo_id", "path", "content"]
    for place in (p for batch in batches for p in batch.column("place").to_pylist()):
        fs, base = open_place(place)
        rows, size = [], 0
        with fs.open_input_stream(base, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz", encoding="utf-8") as tar:
            for info in tar:
                repo, _, path = info.name.partition("/")
                rows.append((repo, path, tar.extractfile(info).read()))
                size += info.size + 512
                if size >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def open_place(place: str):
    return pafs.FileSystem.from_uri(place)


def decode_text(data: bytes) -> str | None:
    """UTF-8 where valid, else Latin-1; None for content with NUL bytes."""
    if b"\x00" in data:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def select_surface(files: DataFrame, surface: str) -> DataFrame:
    """Rows of one audit's surface. Only filters on path and size: pushed to the scan where possible."""
    rule = SURFACES[surface]
    path = F.col("path")
    keep = P.suffix(path).isin(rule["suffixes"])
    if rule["names"]:
        keep = keep | P.name(path).isin(rule["names"])
    if rule["skip"]:
        keep = keep & ~F.arrays_overlap(P.directories(path), P.strings(rule["skip"]))
    if rule.get("prune_dot_dirs"):
        keep = keep & ~path.rlike(r"(?:^|/)\.[^/]*/")
    if rule.get("reject_minified"):
        keep = keep & ~F.lower(path).endswith(".min.js")
    if rule.get("first_party_only"):
        keep = keep & ~P.is_foreign_runtime(path)
    return files.where(keep)


def split_surface(files: DataFrame) -> DataFrame:
    """Mark every file as first-party or foreign-runtime (tool-installed)."""
    origin = F.when(P.is_foreign_runtime(F.col("path")), F.lit("foreign-runtime")).otherwise(F.lit("first-party"))
    return files.withColumn("origin", origin)


def surface_coverage(files: DataFrame) -> DataFrame:
    """Per repository: first-party and excluded file counts (map-side combined)."""
    return (
        split_surface(files)
        .groupBy("repo_id")
        .agg(
            F.count_if(F.col("origin") == "first-party").alias("first_party"),
            F.count_if(F.col("origin") == "foreign-runtime").alias("foreign_excluded"),
        )
    )


def surface_note(
    first_party: Column, foreign: Column, ignored: Column | None = None, source: Column | None = None
) -> Column:
    """``surface: [source | ]first-party N | foreign-runtime excluded M[ | ignored-actionable K]``."""
    bits = []
    if source is not None:
        bits.append(F.when(source != "git-index", source))
    bits.append(F.concat(F.lit("first-party "), first_party.cast("string")))
    bits.append(F.concat(F.lit("foreign-runtime excluded "), foreign.cast("string")))
    if ignored is not None:
        bits.append(F.concat(F.lit("ignored-actionable "), ignored.cast("string")))
    return F.concat(F.lit("surface: "), F.concat_ws(" | ", *bits))


def repositories(files: DataFrame) -> DataFrame:
    """One row per repository, so that a repository without findings keeps its row."""
    return files.select("repo_id").distinct()
