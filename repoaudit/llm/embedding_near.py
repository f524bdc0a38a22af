"""Near-duplicate vectors: a navigable small-world graph per shard, every shard queried by every vector.

Vectors are dealt to shards of bounded size by a hash. Each shard builds its graph (see ``hnsw``); vectors within half
the link angle of a node join that node's ball, so that all members of a ball are linked with each other and a group
of copies is never paired out. An audit then widens the shard's beam until ``RECALL`` of all near nodes is found,
against brute force, for at most ``AUDITED`` nodes of the shard turned by almost the link angle. Every vector, its
own shard's included, is then sought in every shard: a ball that lies within the link angle as a whole counts with
all its members, of any other ball every member's cosine is computed in double precision. What comes back of a ball
is a count and one link, which is all that link numbers and components need.

Queries meet graphs in blocks: a task holds one graph and streams ``QUERIES`` of the vectors past it. The work is the
number of vectors times the number of shards, as the method has it; a shard holds as many as ``SHARD_BYTES`` allow.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, vectors
of different lengths do not link; rows that repeat an id are vectors of their own in counts, but one node of a
component; a null id is one id, below all others (as component: null); an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import NO_ID, narrow_batches, real_id, stage
from repoaudit.llm.graph import components
from repoaudit.llm.hnsw import MOST_LINKS, Graph, build, moved

COSINE = 0.95
#: Share of near nodes that a shard's beams must find, nodes it is measured on, and the beam it begins with.
RECALL, AUDITED, WIDTH = 0.99, 256, 16
#: Shards at least, and bytes of a shard's vectors at most.
SHARDS, SHARD_BYTES = 8, 32 * 1024 * 1024
#: Vectors that one task seeks in one shard.
QUERIES = 1 << 14
UNITS = "row long, id long, dim int, unit binary"
NODES = "shard int, node int, leader int, row long, id long, dim int, unit binary, links binary, width int, recall double"
ASKED = "row long, id long, n long, other long"
#: Kinds of rows that a task reads, in this order.
GRAPH, QUERY = 0, 1


def _units(batches):
    """Each vector scaled to length one, as doubles; null for vectors that cannot link."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        vectors = batch.column(1)
        values = vectors.values.to_numpy(zero_copy_only=False)
        values = np.where(np.isfinite(values), values, np.nan)  # nulls arrive as NaN
        ends, there = vectors.offsets.to_numpy(), np.asarray(vectors.is_valid())
        units, dims = [], []
        for a, b, valid in zip(ends[:-1], ends[1:], there, strict=True):
            v = values[a:b]
            top = np.abs(v).max(initial=0.0) if valid else 0.0
            good = bool(top > 0)
            units.append((v / top / np.linalg.norm(v / top)).tobytes() if good else None)
            dims.append(int(b - a) if good else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(units))), batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
            names=[c.split()[0] for c in UNITS.split(", ")],
        )
        row += len(units)


def units(vectors: DataFrame) -> DataFrame:
    """``row, id, dim, unit`` of every row of ``vec_id, embedding``; a unit vector is binary doubles, or null."""
    narrow_batches(vectors.sparkSession)
    rows = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    return stage(rows.mapInArrow(_units, UNITS), "unit-vectors")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _groups(batches, keys: int):
    """Runs of rows that agree in the first ``keys`` columns, batch by batch: key, whether it is new, rows."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(key[a].tolist())
            yield own, own != before, batch.slice(a, b - a)
            before = own


def _graph_rows(cosine: float, recall: float):
    angle = math.acos(cosine)

    def finish(key, parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        row, own_id, blobs = (whole.column(i).to_pylist() for i in (2, 3, 4))
        keys = whole.column(5).to_numpy()
        graph, order = build(_matrix(blobs), keys, angle / 2)
        probes = moved(graph.units[: min(graph.n, AUDITED)], 0.98 * angle, int(key[1]))
        width, found = graph.audit(angle, WIDTH, probes, recall)
        links = [b"".join(level[i].tobytes() for level in graph.links if i < len(level)) for i in range(graph.n)]
        n = len(order)
        for a in range(0, n, 4096):
            part = order[a : a + 4096].tolist()
            size = len(part)
            node = np.arange(a, a + size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, key[1], np.int32)),
                    pa.array(node),
                    pa.array(graph.leader[a : a + size].astype(np.int32)),
                    pa.array([row[i] for i in part], pa.int64()),
                    pa.array([own_id[i] for i in part], pa.int64()),
                    pa.array(np.full(size, key[0], np.int32)),
                    pa.array([blobs[i] for i in part], pa.binary()),
                    pa.array([links[i] if i < graph.n else None for i in range(a, a + size)], pa.binary()),
                    pa.array(np.full(size, width, np.int32)),
                    pa.array(np.full(size, found)),
                ],
                names=[c.split()[0] for c in NODES.split(", ")],
            )

    def run(batches):
        key, parts = None, []
        for own, new, rows in _groups(batches, 2):
            if new and parts:
                yield from finish(key, parts)
                parts = []
            key = own
            parts.append(rows)
        if parts:
            yield from finish(key, parts)

    return run


def graphs(rows: DataFrame, cosine: float, recall: float, shards: int) -> DataFrame:
    """One row for each linkable vector of ``units``: its shard, its ball, and a node's links; with the audit's outcome."""
    dealt = rows.where("unit IS NOT NULL").select(
        "dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "id", "unit", F.xxhash64(F.lit(7), "row").alias("key")
    )
    laid = dealt.repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "key")
    return stage(laid.mapInArrow(_graph_rows(cosine, recall), NODES), "vector-graphs")


def _loaded(parts: list[pa.RecordBatch]) -> tuple[Graph, pa.Table, int]:
    """The graph of a shard, put together from its rows in order."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    blobs = [b for b in whole.column("links").to_pylist() if b is not None]
    rows, half = [np.frombuffer(b, np.int32) for b in blobs], MOST_LINKS // 2
    above = np.array([(len(r) - MOST_LINKS) // half for r in rows])  # levels above the lowest
    links = [np.stack([r[:MOST_LINKS] for r in rows])]
    for k in range(int(above.max())):
        at = MOST_LINKS + k * half
        links.append(np.stack([r[at : at + half] for r, up in zip(rows, above, strict=True) if up > k]))
    units = _matrix(whole.column("unit").to_pylist())
    return Graph(units, links, len(rows), whole.column("leader").to_numpy().astype(np.int64)), whole, whole.column("width")[0].as_py()


def _asked(cosine: float):
    def run(batches):
        loading, graph = [], None
        for _, new, rows in _groups(batches, 3):
            if new:
                loading, graph = [], None
            turn = int((rows.column("kind").to_numpy() == GRAPH).sum())
            if turn:
                loading.append(rows.slice(0, turn))
                rows = rows.slice(turn)
            if rows.num_rows and loading:
                graph, table, width = _loaded(loading)
                of_row, of_id, loading = table.column("row").to_numpy(), table.column("id").to_numpy(), []
                by_row = np.argsort(of_row)
            if graph is None:
                continue
            for a in range(0, rows.num_rows, 1024):
                part = rows.slice(a, 1024)
                row, own_id = part.column("row").to_numpy(), part.column("id").to_numpy()
                at = by_row[np.minimum(np.searchsorted(of_row, row, sorter=by_row), len(by_row) - 1)]
                own = np.where(of_row[at] == row, at, -1)
                query, count, other = graph.linked(_matrix(part.column("unit").to_pylist()), cosine, width, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (row[query], own_id[query], count, of_id[other])], names=["row", "id", "n", "other"]
                )

    return run


def asked(rows: DataFrame, nodes: DataFrame, cosine: float, shards: int, blocks: int) -> DataFrame:
    """``row, id, n, other``: for each vector and each ball that links with it, how many members do, and one of them."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["dim", "shard", "block", "kind", "node", "row", "id", "unit", "links", "leader", "width"]
    graph = nodes.select("*", each(blocks).alias("block"), F.lit(GRAPH).alias("kind"))
    block = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(blocks)).cast("int").alias("block")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("links", "binary"), ("leader", "int"), ("width", "int"))]
    query = rows.where("unit IS NOT NULL").select(
        "dim", "row", "id", "unit", block, F.lit(QUERY).alias("kind"), F.lit(0).alias("node"), *none, each(shards).alias("shard")
    )
    laid = (
        graph.select(*columns)
        .unionByName(query.select(*columns))
        .repartitionByRange(shards * blocks, "dim", "shard", "block")
        .sortWithinPartitions("dim", "shard", "block", "kind", "node")
    )
    return stage(laid.mapInArrow(_asked(cosine), ASKED), "vector-links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``vec_id, n_links, component_id, kept`` of every row; and the graphs with their audits."""
    rows = units(vectors)
    about = rows.where("unit IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    shards = max(SHARDS, -(-about.n * (about.dim or 0) * 8 // SHARD_BYTES))
    nodes = graphs(rows, cosine, recall, shards)
    links = asked(rows, nodes, cosine, shards, max(1, -(-about.n // QUERIES)))
    counts = links.groupBy(F.col("row").alias("of")).agg(F.sum("n").alias("n_links"))
    labels = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")), "vectors")
    component = F.coalesce("label", "id")
    named = rows.join(counts, F.col("row") == F.col("of"), "left").join(labels, F.col("id") == F.col("node"), "left")
    result = named.select(
        real_id(F.col("id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        real_id(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
    return result, nodes


def op11_embedding_near(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
