"""Token counts and ids against the vocabulary's own library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repoaudit.llm import token_counts, token_output
from repoaudit.session import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "é", "1", "²", "日", "!", "?", " ", "　", "😀", "<|endoftext|>", "​", "\x1c", "\x85", "ß", ".", ",", "Word"]


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_mixed_white_space_and_special_strings():
    rng = random.Random(1)
    count, encode = token_counts.counter(PATH).count, token_output.encoder(PATH).encode
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        want = ids(text)
        assert count(text) == len(want), text
        assert np.frombuffer(encode(text), "<i4").tolist() == want, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    assert token_counts.counter(PATH).count(text) == len(ids(text))
    assert np.frombuffer(token_output.encoder(PATH).encode(text), "<i4").tolist() == ids(text)


def test_a_batch_of_texts_looks_distinct_chunks_up_once():
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "a\n\nb", "x\ny", "\nz", "a b\n", " a", "a ", "a\x1cb c", "a \x1d", "\x1e0", "end<|endoftext|> of", "a\u2003b c"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["the", "Word.", "x\ny", "é!!", "12", "日,", "a\n1"]) for _ in range(30)) for _ in range(500)]
    made = token_output.Encoder(PATH)
    for kind in (pa.string(), pa.large_string()):
        got, sizes = made.encode_all(pa.array(["cut off", *texts], kind).slice(1), b"\0\0\0\0")
        want = [[*ids(t or ""), 0] for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert got.tolist() == [i for w in want for i in w]
    asked = []
    made.plain.words.__class__ = type("Counted", (type(made.plain.words),), {"__getitem__": lambda self, k: asked.append(k) or dict.__getitem__(self, k)})
    got, sizes = made.encode_all(pa.array(["the word the word\nthe word"] * 50), b"\0\0\0\0")
    assert sizes.tolist() == [len(ids("the word the word\nthe word")) + 1] * 50
    assert sorted(asked) == ["the", "word"]
    assert [len(x) for x in made.encode_all(pa.array([], pa.string()), b"\0\0\0\0")] == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn"]), max_size=60), max_size=5))
def test_any_batch(texts):
    got, sizes = token_output.encoder(PATH).encode_all(pa.array(texts, pa.string()), b"\0\0\0\0")
    assert got.tolist() == [i for t in texts for i in [*ids(t), 0]]
    assert sizes.tolist() == [len(ids(t)) + 1 for t in texts]


def test_long_single_piece():
    text = "ab" * 20_000
    assert token_counts.counter(PATH).count(text) == len(ids(text))


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd_docs).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(ids(r.text or ""))) for r in odd_docs.collect())
    assert got == want
    assert token_counts.token_counts(no_docs).count() == 0


def test_round_trip(spark, odd_docs, no_docs):
    path = stage_path(spark, "test-tokens")
    token_output.write_tokens(odd_docs, path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for (has_id, doc_id, text), row in zip(rows, got, strict=True):
        assert (row.doc_id, row.start, list(row.ids)) == (doc_id if has_id else None, at, [*ids(text), 0])
        at += row.n_tokens
    one = token_output.read_tokens(spark, path).where("doc_id = 7").collect()
    assert len(one) == 1
    assert token_output.token_digests(no_docs, stage_path(spark, "test-none")).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, at = [], 0
    for d in docs:
        own = [*ids(d.text or ""), 0]
        want.append((d.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, token_output.op8_token_output(spark, sf).collect())) == want
    counted = sorted((r.doc_id, r.n_tokens, r.over_limit) for r in token_counts.op3_token_counts(spark, sf).collect())
    assert counted == [(d, n - 1, n - 1 > 512) for d, _, n, _ in want]


@pytest.mark.parametrize("text", ["", "a", " a", "aa", "hello world"])
def test_heap_merging_by_hand(text):
    table = token_counts.merge_table({"model": {"merges": ["h e", "l l", "he ll", "Ġ w"]}})
    naive = [bytes([b]) for b in text.encode()]
    ranked = [(b"h", b"e"), (b"l", b"l"), (b"he", b"ll"), (b" ", b"w")]
    while True:
        found = [(ranked.index(p), i) for i, p in enumerate(zip(naive, naive[1:], strict=False)) if p in ranked]
        if not found:
            break
        _, i = min(found)
        naive[i : i + 2] = [naive[i] + naive[i + 1]]
    assert token_counts.count_symbols(text.encode(), table) == len(naive)
