"""Range streams against a brute-force grouping, with frequent hashes that are cut into several ranges."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from repoaudit.llm.graph import components
from repoaudit.llm.groups import DECIDED, OPEN, ROWS, SUMMARY, _stream, shared


def brute(rows, min_docs, with_owner):
    groups = defaultdict(list)
    for hi, lo, doc, slot in rows:
        groups[hi, lo].append((doc, slot))
    out = []
    for own in groups.values():
        if len({d for d, _ in own}) >= min_docs:
            first = min(own)
            out += [(d, s, first[0], first[1]) for d, s in own if with_owner or d != first[0]]
    return sorted(out)


@pytest.mark.parametrize("min_docs,with_owner", [(2, False), (2, True), (3, False)])
def test_shared_rows(spark, min_docs, with_owner):
    rng = random.Random(3)
    rows = [(7, 1, rng.randrange(400), rng.randrange(5)) for _ in range(900)]
    rows += [(rng.randrange(-50, 50), rng.randrange(2), rng.randrange(60), rng.randrange(9)) for _ in range(600)]
    rows += [(99, 0, 5, s) for s in range(20)] + [(2**63 - 1, 0, -(2**63), 1), (2**63 - 1, 0, 3, 1)]
    rows = sorted(set(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        keyed = [(*r, 31 * r[2] + r[3] if abs(r[2]) < 1000 else 0) for r in rows]
        got, _ = shared(spark.createDataFrame(keyed, ROWS).repartition(4), "t", min_docs, with_owner)
        every = got.collect()
        found = sorted((r.doc, r.slot, r.owner, r.owner_slot) for r in every)
        assert all(r.key == (31 * r.doc + r.slot if abs(r.doc) < 1000 else 0) for r in every)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert found == brute(rows, min_docs, with_owner)


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5], [4, 8]])
def test_stream_over_any_cut(cuts):
    """Any cut of the sorted rows into ranges and batches gives the same rows, once summaries decide the open ones."""
    rng = random.Random(11)
    rows = sorted({(rng.randrange(3), 0, rng.randrange(4), rng.randrange(3)) for _ in range(14)})
    ends = [0, *[c for c in cuts if c < len(rows)], len(rows)]
    said = []
    for a, b in zip(ends, ends[1:], strict=False):
        part = [rows[i : min(i + 2, b)] for i in range(a, b, 2)]
        batches = (pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*((*r, 0) for r in p), strict=True)], names=list("abcde")) for p in part)
        for out in _stream(2, True)(batches):
            said += list(zip(*(c.to_pylist() for c in out.columns), strict=True))
    firsts = defaultdict(set)
    for doc, slot, _, _, hi, _, kind, _ in said:
        if kind == SUMMARY:
            firsts[hi].add((doc, slot))
    known = {h: min(s) for h, s in firsts.items() if len({d for d, _ in s}) >= 2}
    got = [(d, s, o, os) for d, s, o, os, _, _, k, _ in said if k == DECIDED]
    got += [(d, s, *known[hi]) for d, s, _, _, hi, _, k, _ in said if k == OPEN and hi in known]
    assert sorted(got) == brute(rows, 2, True)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(300)] + [(-5, 900), (900, 3000)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0
