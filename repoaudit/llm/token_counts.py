"""Token counts by byte-pair merging, without token ids.

Method: the symbols of a piece form a linked list; a heap holds the adjacent pairs that have a merge, and the pair of
lowest rank (the leftmost on a tie) is popped and merged until none is left. A piece has as many tokens as it has
bytes less merges. Texts are cut into chunks that cannot influence each other, so that each distinct chunk of a
worker's memory is merged once.

Defined cases: a null or empty text has no bytes and no tokens. Special strings inside a text are single tokens, as
the tokenizer's library treats them by default. Repeated rows get equal counts; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.chunks import Chunked, byte_letters
from repoaudit.llm.common import documents, narrow_batches

VOCABULARY = "byte_bpe_50k.json"
SHIFT = 32


def merge_table(spec: dict) -> dict[int, tuple[int, int]]:
    """Rank and resulting symbol of every mergeable pair of symbols; a byte is its own symbol."""
    symbol: dict[str, int] = {letter: b for b, letter in byte_letters().items()}
    table = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        made = symbol.setdefault(a + b, len(symbol))
        table[symbol[a] << SHIFT | symbol[b]] = (rank, made)
    return table


def count_symbols(piece: bytes, table: dict[int, tuple[int, int]]) -> int:
    """Symbols left of a piece when no adjacent pair has a merge: its bytes less the merges made."""
    n = left = len(piece)
    symbol = list(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    due = [-1] * n  # rank of the merge that waits at a symbol, none: -1
    heap, get = [], table.get
    for i in range(n - 1):
        if found := get(symbol[i] << SHIFT | symbol[i + 1]):
            due[i] = found[0]
            heap.append(found[0] << SHIFT | i)
    heapify(heap)
    while heap:
        top = heappop(heap)
        a = top & (1 << SHIFT) - 1
        if due[a] != top >> SHIFT:
            continue  # one of the two symbols has been merged since
        b = after[a]
        symbol[a] = table[symbol[a] << SHIFT | symbol[b]][1]
        due[b] = -1
        left -= 1
        after[a] = c = after[b]
        due[a] = -1
        if c < n:
            before[c] = a
            if found := get(symbol[a] << SHIFT | symbol[c]):
                due[a] = found[0]
                heappush(heap, found[0] << SHIFT | a)
        if (z := before[a]) >= 0:
            due[z] = -1
            if found := get(symbol[z] << SHIFT | symbol[a]):
                due[z] = found[0]
                heappush(heap, found[0] << SHIFT | z)
    return left


class Counter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        table = merge_table(spec)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.plain = Chunked(lambda p: count_symbols(p.encode(), table), sum)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One counter a Python worker, so that later tasks find its memory filled."""
    return Counter(path)


def _counts(vocabulary: str):
    def run(batches):
        count = counter(public_tokenizers.path(vocabulary)).count
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(map(count, texts), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    narrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(_counts(vocabulary), "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)
