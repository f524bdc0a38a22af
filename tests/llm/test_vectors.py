"""Near-duplicate vectors against brute force: links, components, recall, odd and empty tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoaudit.llm import embedding_near, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(ids, vectors, cosine=0.95):
    """``vec_id, n_links, component_id, kept`` of each row, all pairs compared."""
    good = [
        v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors
    ]
    n, root = len(ids), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = [0] * n
    for dim in {len(v) for v, g in zip(vectors, good, strict=True) if g}:
        rows = [i for i in range(n) if good[i] and len(vectors[i]) == dim]
        u = np.array([vectors[i] for i in rows], np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for a, row in enumerate(rows):
            for b in np.flatnonzero(u @ u[a] >= cosine):
                if b != a:
                    links[row] += 1
                    x, y = find(ids[row]), find(ids[rows[b]])
                    root[max(x, y)] = min(x, y)
    return [(i, k, find(i), find(i) == i) for i, k in zip(ids, links, strict=True)]


def corpus(seed=3):
    """Vectors in loose bundles, with a tight group of a third of all, chains of near copies, and exact copies."""
    rng = np.random.default_rng(seed)
    around = rng.standard_normal((12, 24)).repeat(40, 0) * 2 + rng.standard_normal((480, 24))
    hot = np.tile(rng.standard_normal(24), (300, 1)) + 0.1 * rng.standard_normal((300, 24))
    chain = [rng.standard_normal(24)]
    for _ in range(60):
        chain.append(chain[-1] + 0.32 * np.linalg.norm(chain[-1]) / math.sqrt(24) * rng.standard_normal(24))
    exact = np.repeat(rng.standard_normal((5, 24)), 8, 0)
    every = np.concatenate([around, hot, np.array(chain), exact])
    return every[rng.permutation(len(every))].astype(np.float32)


def compare(spark, vectors, cosine=0.95):
    rows = [(i * 3 + 7, v.tolist(), 0) for i, v in enumerate(vectors)]
    got, nodes = embedding_near.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), cosine)
    found = {r.vec_id: tuple(r) for r in got.collect()}
    want = {r[0]: r for r in by_hand([r[0] for r in rows], [r[1] for r in rows], cosine)}
    return found, want, nodes


@pytest.mark.parametrize("cosine", [0.95, 0.8])
def test_links_and_components_against_all_pairs(spark, cosine):
    found, want, nodes = compare(spark, corpus(), cosine)
    assert found.keys() == want.keys()
    assert all(found[i][1] <= want[i][1] for i in want)
    total, met = (sum(r[1] for r in side.values()) for side in (want, found))
    assert total > 80_000 and met >= 0.99 * total
    assert sum(found[i][2] == want[i][2] for i in want) >= 0.99 * len(want)
    audits = nodes.where("links IS NOT NULL").select("shard", "width", "recall").distinct().collect()
    assert len(audits) == embedding_near.SHARDS and min(a.recall for a in audits) >= embedding_near.RECALL
    assert nodes.where("links IS NULL").count() > 200  # the group of a third of all is members, not nodes


def test_links_of_a_given_table(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rows = spark.read.parquet(path).collect()
    got = sorted(map(tuple, embedding_near.op11_embedding_near(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(by_hand([r.vec_id for r in rows], [r.embedding for r in rows]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-38, 1e-39]), (11, [0.0, 1.0]), (12, [0.0, 5.0]), (None, [3e38, 1e37]),
        (None, None), (13, [1.0]), (14, [-2.0]), (15, [3.0]), (7, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA).withColumns(
        {c: F.lit(f"extra {c}") for c in ("row", "id", "unit", "n", "node", "shard", "dim")}
    )
    got = embedding_near.near_vectors(df.repartition(4))[0].collect()
    low = -(2**63)
    want = by_hand([low if i is None else i for i, _ in vectors], [v for _, v in vectors])
    real = lambda x: None if x == low else x
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((real(a), n, real(c), k) for a, n, c, k in want), key=key)
    assert {(r.vec_id, r.n_links) for r in got} >= {(7, 4), (3, 0), (6, 0), (9, 0), (13, 1), (14, 0)}


def test_empty_table_and_one_row(spark):
    assert embedding_near.near_vectors(spark.createDataFrame([], SCHEMA))[0].collect() == []
    one = embedding_near.near_vectors(spark.createDataFrame([(5, [1.0, 2.0], 0)], SCHEMA))[0].collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def test_full_beams_are_widened():
    """One node has more neighbours than the first beam holds: none is lost."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    units = hnsw.moved(np.tile(base / np.linalg.norm(base), (300, 1)), 0.30, 2)
    graph, order = hnsw.build(units, rng.integers(-(2**63), 2**63 - 1, 300), 0.01)
    assert graph.n == 300
    query, node = graph.near(base[None] / np.linalg.norm(base), 0.31, 4)
    assert sorted(node.tolist()) == list(range(300))


def test_nodes_of_each_level_come_first_and_every_vector_has_a_ball():
    rng = np.random.default_rng(5)
    units = rng.standard_normal((3000, 16))
    units[1000:2000] = units[:1]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    graph, order = hnsw.build(units, rng.integers(-(2**63), 2**63 - 1, 3000), 0.1)
    assert sorted(order.tolist()) == list(range(3000)) and np.allclose(graph.units, units[order])
    assert (np.einsum("id,id->i", graph.units, graph.units[graph.leader]) >= math.cos(0.1) - 1e-12).all()
    assert (graph.leader[: graph.n] == np.arange(graph.n)).all() and graph.sizes.max() >= 1000
    for k, links in enumerate(graph.links):
        assert links.max() < len(links) and (k == 0 or len(links) < len(graph.links[k - 1]))
