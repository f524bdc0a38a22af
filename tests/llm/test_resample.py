"""Importance resampling and the filter audit: brute force, SQL, odd rows, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repoaudit.llm import filter_audit, resample
from repoaudit.llm.oracles import ORACLES
from repoaudit.llm.queries import QUERIES
from repoaudit.llm.radix import digits, ranked
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_resample", "op13_filter_audit"])
def test_statement(spark, name):
    text, ok = compare(spark, connect(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, text


def test_digits_cover_the_key():
    assert digits(5, 5) == []
    assert digits(0, 1) == [(0, 1)]
    for low, high in ((0, 4095), (-3, 2**40), (-(2**63), 2**63 - 1)):
        parts = digits(low, high)
        assert all(w <= 12 for _, w in parts) and parts[-1][0] + parts[-1][1] >= (high - low).bit_length()


@pytest.mark.parametrize("keys", [[("a", True), ("b", False)], [("b", False)], [("same", True)], [("far", True), ("a", False)]])
def test_ranks_are_those_of_a_stable_sort(spark, keys):
    rows = [(i % 7, i // 7, (i * 7919) % 101 - 50, (i * 31) % 211, 5, (-1) ** i * (2**62 + i % 3)) for i in range(9000)]
    df = spark.createDataFrame(rows, "_block long, _at long, a long, b long, same long, far long").repartition(5)
    got, n = ranked(df.withColumn("first", F.col("_block") * 10_000 + F.col("_at")), keys, "test")
    at = {"a": 2, "b": 3, "same": 4, "far": 5}
    want = sorted(rows, key=lambda r: (*(-r[at[c]] if falling else r[at[c]] for c, falling in keys), r[0], r[1]))
    assert n == len(rows)
    assert [r.first for r in sorted(got.collect(), key=lambda r: r.rank)] == [r[0] * 10_000 + r[1] for r in want]
    assert sorted(r.rank for r in got.collect()) == list(range(1, n + 1))


def by_hand(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    of = lambda t: [zlib.crc32(w.encode()) % 10000 for w in word.findall(low(t))]
    s, t = (Counter(b for x in texts for b in of(x)) for texts in ([d[1] for d in docs], items))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10000)) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for doc, text in docs:
        found = of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    inside = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(inside[: 10 * len(inside) // 100], 1):
        r[4] = rank
    return out


ITEMS = ["Which river flows north? The Nile does.", "prime numbers under 20", None, ""]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id long, text string")


def test_resampling_of_odd_rows(spark, odd_docs, make_docs, items):
    more = [(100 + i, "the river " * (5 + i) + f"Flows {i} ünder prime-numbers; NORTH") for i in range(60)]
    docs = odd_docs.unionByName(make_docs(more), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample.resampled(docs, items).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, by_hand(rows, ITEMS)), key=key)


def test_resampling_of_empty_tables(spark, no_docs, make_docs, items):
    assert resample.resampled(no_docs, items).collect() == []
    one = resample.resampled(make_docs([(1, "word " * 30)]), items.where("item_id < 0")).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in one] == [(1, 30, None)]


def test_longer_runs_of_words(spark, make_docs, items):
    got = resample.resampled(make_docs([(1, "a b c d")]), items, run=3, least=4, percent=100).collect()
    assert [(r.n_features, r.rank) for r in got] == [(4 + 3 + 2, 1)]


def audit_by_hand(docs, labels):
    """Steps of all orders, by running every order over every document."""
    smallest = {}
    for doc, text, _ in docs:
        smallest[text or ""] = min(smallest.get(text or "", doc), doc)
    rows = []
    for doc, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": doc > smallest[t],
        }
        rows.append((lang or "", fails, *labels.get(doc, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in own)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    rows = filter_audit.audit(filter_audit.mask_counts(docs, labels)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_audit_against_every_order_run_by_hand(spark, make_docs):
    texts = [
        "word " * 250, " ".join(f"w{i}" for i in range(300)), "SHOUT " * 30, "a # b", None, "", "word " * 250, "a # b", None,
        " ".join(f"w{i}" for i in range(300)) + " $", "É" * 400 + " AB", "X Y\x0bZ\x1fq",
    ]
    rows = [(i, t, ("en", "de", None, "")[i % 4], "s") for i, t in enumerate(texts * 3)]
    said = {i: (i % 2, i % 3 == 0) for i in range(0, 36, 2)}
    labels = spark.createDataFrame([(k, q, int(t)) for k, (q, t) in said.items()], "doc_id long, quality int, toxic int")
    assert audited(make_docs(rows), labels) == audit_by_hand([r[:3] for r in rows], said)


def test_audit_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, None), (3, None, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = [(-(2**63) if r.doc_id is None else r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert audited(odd_docs, labels) == audit_by_hand(rows, {3: (1, 1)})
    assert audited(no_docs, labels) == {}
    assert len(audited(odd_docs, labels.limit(0))) == 2 * 120 * 5


def test_adjacent_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == math.factorial(n)
