"""Line and passage de-duplication, near duplicates, decontamination: brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from repoaudit.llm import decontaminate, line_dedup, ngram_join, substrings
from repoaudit.llm.common import keyed, real_id

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines_by_hand(rows):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and doc != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out)


def run_lines(docs):
    rows = line_dedup.with_bitmaps(docs).select(real_id(F.col("doc")).alias("doc_id"), "text", "keep")
    out = rows.mapInArrow(line_dedup._digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return [tuple(r) for r in out.collect()]


def test_lines(make_docs):
    rng = random.Random(2)
    pool = ["short", "", "  A LINE that is long enough ", "a line THAT is long enough", "é" * 19 + "x", "é" * 19, "another line that is long\t", "third line of twenty chars"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(50, None), (51, "")]
    assert sorted(run_lines(make_docs(rows))) == lines_by_hand(rows)


def test_lines_of_odd_rows(odd_docs, no_docs):
    got = run_lines(odd_docs)
    assert len(got) == odd_docs.count() and (1, 1, 0, sha("")) in got
    assert all(n == 0 for _, _, n, _ in got)
    assert run_lines(no_docs) == []


def test_line_in_every_document_keeps_the_last(make_docs):
    got = run_lines(make_docs([(i, "the very same line for all of them\nown") for i in range(300)], parts=7))
    assert sum(n for _, _, n, _ in got) == 299 and (299, 2, 0, sha("the very same line for all of them\nown")) in got


def passages_by_hand(rows):
    n, first = substrings.PASSAGE, {}
    words = [(doc, WORD.findall(text or "")) for doc, text in rows]
    for doc, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, w in words:
        gone = {p for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < doc for p in range(i, i + n)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def run_passages(docs):
    rows = substrings.keyed(docs).join(substrings.repeated_passages(docs), substrings.ROW, "left")
    rows = rows.select(real_id(F.col("doc")).alias("doc_id"), "text", "whole", "starts")
    return [tuple(r) for r in rows.mapInArrow(substrings._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()]


def test_cover_meets_every_pair_of_positions():
    p, cover = substrings.PERIOD, set(substrings.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))
    assert substrings.ANCHOR + p - 1 == substrings.PASSAGE


def test_passages(make_docs):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(k)] for k in (49, 50, 51, 90, 200)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 3) :]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(70, rows[3][1]), (71, rows[3][1].replace(" ", "\n")), (72, " ".join(["same"] * 120)), (73, " ".join(["same"] * 70))]
    assert sorted(run_passages(make_docs(rows))) == passages_by_hand(rows)


def test_passages_of_odd_rows(odd_docs, no_docs):
    got = run_passages(odd_docs)
    assert len(got) == odd_docs.count()
    assert sorted((d, n, r) for d, n, r, _ in got if d in (4, 5)) == [(4, 30_001, 0), (5, 30_001, 30_001)]
    assert run_passages(no_docs) == []


def sets_by_hand(rows):
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        out.append((doc, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()))
    return out


def components_by_hand(rows):
    sets = sets_by_hand(rows)
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def run_join(docs):
    found = ngram_join.clusters(docs)
    return [tuple(r) for r in found.select(real_id(F.col("doc")), "n_shingles", real_id(F.col("component"))).collect()]


@pytest.mark.parametrize("bucket", [2, 24])
def test_near_duplicates(make_docs, monkeypatch, bucket):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, n = [], 0
    for _ in range(12):  # families of copies, edits near the limit, and chains of edits
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            base = w if rng.random() < 0.4 else base
            rows.append((n, " ".join(x.upper() if rng.random() < 0.05 else x for x in w)))
            n += 1
    shared_part = " ".join(word() for _ in range(60))
    rows += [(n + i, f"{shared_part} {' '.join(word() for _ in range(40))}") for i in range(30)]
    rows += [(n + 40, None), (n + 41, ""), (n + 42, "one two"), (n + 43, "One  two"), (n + 44, "two one")]
    assert sorted(run_join(make_docs(rows))) == components_by_hand(rows)


def test_texts_that_are_mostly_shared_passages(make_docs):
    """Passages of all lengths in many texts, with own words around the threshold, some with parts of a second passage."""
    rng = random.Random(7)
    fresh = lambda k, tag: [f"{tag}{rng.randint(0, 10**9)}" for _ in range(k)]
    passages, texts = [fresh(n, "p") for n in (50, 80, 120, 300)], []
    for p in passages:
        for k in (4, 8, 11, 14, 20, 30, 60):
            for _ in range(9):
                cut, own = p[rng.randint(0, 4) :], fresh(rng.randint(max(1, k - 2), k + 2), "o")
                extra = rng.choice(passages)[: rng.randint(10, 50)] if rng.random() < 0.2 else []
                texts.append(" ".join((own + cut if rng.random() < 0.5 else cut + own) + extra))
    texts += [" ".join(fresh(rng.randint(5, 150), "z")) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert sorted(run_join(make_docs(rows, parts=40))) == components_by_hand(rows)


def test_one_passage_in_many_texts_makes_few_candidates(make_docs, monkeypatch):
    """No pair of them is similar; candidates do not grow with the square of their number."""
    rng = random.Random(1)
    fresh = lambda k: [f"w{rng.randint(0, 10**9)}" for _ in range(k)]
    passage, seen = fresh(60), []
    whole = ngram_join._Classes.linked

    def counted(self, pairs, name):
        seen.append(pairs.count())
        return whole(self, pairs, name)

    monkeypatch.setattr(ngram_join._Classes, "linked", counted)
    rows = [(i, " ".join(passage + fresh(11))) for i in range(200)]
    got = {r.doc: r.component for r in ngram_join.clusters(make_docs(rows, parts=100)).collect()}
    assert got == {i: i for i in range(200)} and sum(seen) <= len(rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = Counter(run_join(odd_docs))
    assert got[(3, 1, 3)] == 2 and got[(4, 2, 4)] == 1 and got[(5, 2, 4)] == 1 and got[(1, 0, 1)] == 1
    assert sum(got.values()) == odd_docs.count()
    assert run_join(no_docs) == []
    kept = ngram_join.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 3, 4, 6, 7]


def decontamination_by_hand(rows, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))
    windows = {}
    for name, text in items:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name) if name is not None else "null")
    out = []
    for doc, text in rows:
        w, hit, names = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    names |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_words", [500_000, 25])
def test_decontamination(spark, make_docs, most_words):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "C", "dé", "x1", "Y"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 16)))) for i in range(9)] + [(None, "null Item, words"), (3, None), (4, "")]
    rows = [(i, rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(50, None), (50, None), (51, "x null item words y"), (52, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scanned(make_docs(rows), bench, most_words)
    assert sorted(((r.doc, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == decontamination_by_hand(rows, items)
    clean = decontaminate.clean(make_docs(rows), bench, most_words)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _, hit, _ in decontamination_by_hand(rows, items) if not hit)


def test_decontamination_spans_and_empty_tables(spark, make_docs, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = make_docs([(1, "Zero, ONE -- two\nthree!"), (2, "one two")])
    hits = decontaminate.scanned(docs, bench)
    got = decontaminate.spans(docs, hits).collect()
    assert [(r.doc_id, "Zero, ONE -- two\nthree!"[r.spans[0].start : r.spans[0].end]) for r in got] == [(1, "ONE -- two\nthree")]
    assert decontaminate.scanned(no_docs, bench).count() == 0
    assert decontaminate.scanned(odd_docs, bench.limit(0)).count() == odd_docs.count()


@pytest.fixture(scope="module")
def alike():
    """Two different texts that agree in the 31 bits which a row carries beside its position."""
    seen = {}
    for i in range(400_000):
        text = f"the first line of the text number {i}\n" + " ".join(f"w{i}x{j}" for j in range(60))
        low = xxhash.xxh64_intdigest(text.encode(), 42) & (2**31 - 1)
        if low in seen:
            return seen[low], text
        seen[low] = text
    raise AssertionError("no collision")


def test_rows_that_share_a_short_key_stay_apart(spark, make_docs, alike):
    a, b = alike
    keys = keyed(make_docs([(None, a), (None, b)])).collect()
    assert len({r.row_key for r in keys}) == 1 and len({r.key for r in keys}) == 2
    line = a.split("\n")[0]
    lines = run_lines(make_docs([(None, a), (None, b), (1, line), (2, line)]))
    assert sorted(n for d, _, n, _ in lines if d is None) == [0, 1]
    words = run_passages(make_docs([(5, a), (5, b), (1, a.split("\n")[1])]))
    assert sorted(n for d, _, n, _ in words if d == 5) == [0, 60]
    kept = ngram_join.representatives(make_docs([(None, a), (None, b)])).collect()
    assert {r.text for r in kept} == {a, b}
    bench = spark.createDataFrame([(1, a.split("\n")[1]), (2, "no such words here at all")], "item_id long, text string")
    hits = decontaminate.scanned(make_docs([(None, a), (None, b)]), bench, 10)
    assert sorted((r.n_words, r.n_hit) for r in hits.collect()) == [(68, 0), (68, 60)]


def test_near_copies_without_an_id_are_reduced_to_one(make_docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 50, 97)]
    rows = [(None, " ".join(base)), *((None, t) for t in near), (None, near[0]), (None, "a text of its own that has nobody like it"), (9, " ".join(base))]
    kept = ngram_join.representatives(make_docs(rows)).collect()
    assert len(kept) == 2 and {len((r.text or "").split()) for r in kept} == {100, 10} and all(r.doc_id is None for r in kept)
