"""Personal data, quality, mixing, toxicity and the pipeline: brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoaudit.llm import mixing, pii, quality, toxicity
from repoaudit.session import stage

SMALL = "/root/testdata/sf0.001"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_by_hand(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [[m.span() for m in BASE[k].finditer(text) if fits(k, m[0])] for k in pii.KINDS]


def test_base_patterns():
    rng = random.Random(5)
    for alphabet in ("0123456789..--  ++()@@abZ%_\né٣", "4111 -", "a.@", "12.. "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == base_by_hand(text), text


def test_personal_data_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.op1_pii(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_by_hand(texts[r.doc_id])
        said = [f"{k}:{s}:{e}" for k, own in zip(pii.KINDS, spans, strict=True) for s, e in own]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, spans))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}


def test_field_carries_labels_to_repeated_mentions(make_docs):
    rng = random.Random(1)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = []
    for i in range(200):
        n = number()
        rows.append((i, f"call +1 {n} or write to u{i}@mail.example.com. order {rng.randrange(10**7, 10**8)} " + "x " * 50))
    last = rows[0][1] + f"again {rows[0][1][8:20]} and u0 (at) mail.example.com"
    rows[0] = (0, last)
    got = {r.doc_id: r.spans for r in pii.personal_data(make_docs(rows)).collect()}
    kinds = Counter(s.split(":")[0] for s in got[0].split(","))
    assert kinds["phone"] == 2 and kinds["email"] == 2
    assert all(len(got[i].split(",")) == 2 for i in range(1, 200))


def neutral_field(weight, neighbours=None):
    """A field without local evidence: equal labels along skip edges weigh ``weight``."""
    field = pii.Field([])
    size = len(pii.KINDS) + 1
    field.alike, field.neighbours = np.eye(size) * weight, np.zeros((size, size)) if neighbours is None else neighbours
    return field


def test_labels_cross_any_number_of_repeats():
    far = " " + "x " * pii.NEAR
    text = "+1 415-555-2671" + "".join(f"{far}415-555-2671" for _ in range(50))
    nodes = pii.mentions(text, pii.base_spans(text))
    assert [n["label"] for n in nodes] == [4] + [0] * 50
    got = neutral_field(6.0).marginals([nodes])[:, 4]
    # three labels fit the form of the number; a hop keeps the label with this much more weight than a change to another
    keep = (np.exp(6) - 1) / (np.exp(6) + 2)
    assert got == pytest.approx([1 / 3 + 2 / 3 * keep**k for k in range(51)], abs=1e-6)
    assert sum(got[1:] >= pii.SURE) >= 45


def test_sweeps_are_exact_without_loops_and_end_with_them():
    rng = np.random.default_rng(3)
    size = len(pii.KINDS) + 1
    exact = 0
    for _ in range(60):
        parts = [str(rng.choice(["+1 415-555-2671", "415-555-2671", "(415) 555 2671", "303-555-0000"])) for _ in range(5)]
        text = "".join(p + " " + "x " * int(rng.choice([5, pii.NEAR])) for p in parts)
        nodes = pii.mentions(text, pii.base_spans(text))
        field = neutral_field(rng.uniform(0.5, 6), rng.uniform(-2, 2, (size, size)))
        field.by_feature = rng.normal(size=field.by_feature.shape)
        got = field.marginals([nodes])
        assert np.isfinite(got).all() and got.sum(1) == pytest.approx(np.ones(len(nodes)))
        chain, skip = pii.edges(nodes)
        root = list(range(len(nodes)))
        for i, j in chain + skip:
            root = [root[i] if r == root[j] else r for r in root]
        if len(chain) + len(skip) != len(nodes) - len(set(root)):
            continue
        exact += 1
        x = np.array([n["values"] for n in nodes])
        own = np.where(pii.possible(x), x @ field.by_feature, -30.0)
        for n, node in enumerate(nodes):
            if node["label"]:
                own[n] = np.where(np.arange(size) == node["label"], 0.0, -30.0)
        want = np.zeros_like(got)
        for labels in itertools.product(range(size), repeat=len(nodes)):
            score = sum(own[n, y] for n, y in enumerate(labels))
            score += sum(field.neighbours[labels[i], labels[j]] for i, j in chain) + sum(field.alike[labels[i], labels[j]] for i, j in skip)
            want[np.arange(len(nodes)), labels] += np.exp(score)
        assert got == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)
    assert exact >= 5


def test_personal_data_of_odd_rows(odd_docs, no_docs):
    got = pii.personal_data(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.spans for r in got} == {""}
    assert pii.personal_data(no_docs).count() == 0


def counts_by_hand(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_fences(make_docs, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 90))), "en", f"s{i % 2}") for i in range(300)]
    rows += [(900, " ".join(f"###w{i}$$$%%%" for i in range(60)), "en", "s0"), (901, "same line of words\n" * 30, "en", "s1"), (902, "a b", None, None)]
    got = {r.doc_id: r for r in quality.judged(make_docs(rows)).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(got[i].kept for i in range(300)) and not got[900].kept and not got[901].kept and not got[902].kept
    for docs in (odd_docs, no_docs):
        assert sorted(map(repr, quality.judged(docs).select("n_words", "n_repeat_words").collect())) == sorted(
            f"Row(n_words={c[0]}, n_repeat_words={c[4]})"
            for c in (counts_by_hand(r.text or "") for r in docs.collect())
        )


def test_every_fence_can_reject_a_text_that_passes_the_base_rules(make_docs):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    rows = [(i, " ".join(words(rng.randint(30, 90))), "en", "s") for i in range(200)]
    beyond = {
        "symbol_rate": " ".join(f"#{w}" if i % 3 == 0 else w for i, w in enumerate(words(60))),
        "dup_line_rate": "\n".join([*words(60), *["same"] * 14]),
        "mean_chars": " ".join(w * 9 for w in words(60)),
    }
    rows += [(1000 + i, text, "en", "s") for i, text in enumerate(beyond.values())]
    got = {r.doc_id: r for r in quality.judged(make_docs(rows)).collect()}
    assert set(quality.MEASURES) == set(quality.REACH) == set(beyond)
    for i, own in enumerate(beyond):
        r = got[1000 + i]
        assert not r.base_failed and not r.kept
        assert [m for m in beyond if r[m] > r[f"most_{m}"]] == [own]


def test_sketch_buckets(spark):
    values = [*range(200), 1000, 12345, 2**40 + 3]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    for v, b in rows.collect():
        assert b <= v and (v - b) * 128 <= max(v, 1)
    ends = rows.where("b > 0").select("v", quality.bucket_end(F.col("b")).alias("e")).withColumn("e_b", quality.bucket(F.col("e")))
    assert all(r.v <= r.e for r in ends.collect()) and ends.where(quality.bucket(F.col("v")) != F.col("e_b")).count() == 0


def test_the_same_text_passes_in_one_group_and_fails_in_another(make_docs):
    """Fences are a group's own: long words and marks are common in one source and not in the other."""
    rng = random.Random(2)
    plain = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    formal = lambda n: [f"{'#' if rng.random() < 0.3 else ''}word{rng.randrange(10 ** rng.randint(1, 9))}" for _ in range(n)]
    rows = [(i, " ".join((plain if i % 2 else formal)(rng.randint(30, 90))), "en", "plain" if i % 2 else "formal") for i in range(600)]
    odd = " ".join(formal(60))
    rows += [(1000, odd, "en", "plain"), (1001, odd, "en", "formal")]
    got = {r.doc_id: r for r in quality.judged(make_docs(rows)).collect()}
    assert not got[1000].base_failed and not got[1000].kept and got[1001].kept
    assert got[1000].most_symbol_rate != got[1001].most_symbol_rate and got[1000].most_mean_chars < got[1001].most_mean_chars


def test_labelled_texts(spark):
    """Of the labelled texts that pass the base rules, bad ones go and good ones stay; fences differ between groups."""
    sf = "/root/testdata/sf0.1"
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    passing = rows.where("NOT base_failed").cache()
    n = {(r.quality, r.kept): r["count"] for r in passing.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.001 * n[1, True]
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    assert all(passing.select(f"most_{m}").distinct().count() > 3 for m in quality.MEASURES)


def test_mixing_targets(make_docs, odd_docs, no_docs):
    sizes = {"a": 10, "b": 4000, "c": 500, "d": 9, None: 300}
    rows = [(100 * i + j, "w " * (n // 5), "en", s) for i, (s, n) in enumerate(sizes.items()) for j in range(5)]
    got = {r.source: r.target for r in mixing.targets(mixing.sized(make_docs(rows))).collect()}
    size = {s: 5 * (n // 5) for s, n in sizes.items()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    assert got == pytest.approx(target)
    for docs in (odd_docs, no_docs):
        mixed = mixing.mixed(docs).collect()
        assert len(mixed) == docs.count() and all(0 <= r.copies <= 2 for r in mixed)
        assert mixing.taken(docs).columns == docs.columns
        assert mixing.taken(docs).count() == sum(r.copies for r in mixed)


def test_mix_comes_near_its_targets_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    got = mixing.op6_mixing(spark, sf).toPandas()
    again = mixing.op6_mixing(spark, sf).toPandas()
    key = ["doc_id", "size"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    sources = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    per = got.merge(sources, on="doc_id").groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= 2 * per.most).all()


def test_obfuscated_insults_count_at_each_occurrence():
    of = toxicity.Features({}).of
    at = toxicity.FEATURES.index("obfuscated")
    once, often = of(b"such an tr@sh here"), of(b"such an tr@sh here " * 50)
    assert once[at] == often[at] == 1 / 5
    assert toxicity.obfuscated(b"tr@sh, TR@SH; trash 12345 tr@sh", {b"trash"}) == 3


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.7 * got.toxic.sum()


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(8)] + [(4, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    none = toxicity.fit(odd_docs, labels.limit(0)).score(odd_docs, "s")
    assert {r.s for r in none.collect()} == {0.0}
    assert toxicity.accepted(no_docs, labels).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, apply in corpus_pipeline.STAGES:
        seen.append(stage(apply(spark, seen[-1], SMALL), f"test-{name}"))
    start, clean, single, free, mixed, tokens = seen
    assert all(x.columns == columns for x in (clean, single, free, mixed))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = {r.doc_id for r in start.collect()} - {r.doc_id for r in clean.collect()}
    assert sum(labels.get(d) == 0 for d in gone) <= 2  # of 58 training rows
    from tests.llm.test_texts import components_by_hand, decontamination_by_hand

    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in components_by_hand(pairs)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in decontamination_by_hand([(r.doc_id, r.text) for r in single.collect()], items) if n}
    assert rows(free) == [x for x in rows(single) if x[0] not in hit]
    assert set(rows(mixed)) <= set(rows(free)) and max(Counter(rows(mixed)).values()) <= 2
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in mixed.collect())
