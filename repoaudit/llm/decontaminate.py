"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Normalised words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The automaton's alphabet
are the words of the items, its patterns all windows of ten consecutive item words (an item with fewer is one
window). A text becomes a sequence of word numbers, 0 for words that no item has, and is scanned once; hits are word
ranges, mapped back to offsets of the original text on demand.

The items of one automaton are bounded by ``AUTOMATON_WORDS``; a larger benchmark is taken in blocks of that size, one
scan each, and the findings of the blocks are united.

Defined cases: null or empty texts have no words; items without words are no windows; items with equal ids are one
item; a null item id is written ``null``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.llm.common import ROW, documents, keyed, real_id, texts

WINDOW = 10
#: Item words in one automaton: about 10 trie nodes of 60 bytes a word.
AUTOMATON_WORDS = 500_000
#: Every byte that is no part of a word becomes a space; A-Z become a-z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Matcher:
    """An automaton over word numbers, with the items of every window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                holders.setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, names in holders.items():
            self.automaton.add_word(ids, (len(ids), names))
        self.empty = not holders
        if holders:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the windows that occur, joined where they touch, and their items."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not found:
            return ranges, items
        get = self.numbers.get
        for last, (size, names) in self.automaton.iter(tuple([get(w, 0) for w in found])):
            items |= names
            a, b = last + 1 - size, last + 1
            while ranges and a <= ranges[-1][1]:
                a = min(a, ranges.pop()[0])
            ranges.append((a, b))
        return ranges, items


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character ranges of word ranges, in the original text."""
    at = [m.span() for m in WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def item_blocks(benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in blocks that one automaton may hold; a single longer item is a block of its own."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).orderBy("item", "text")
    held, size = [], 0
    for item, text in items.toLocalIterator():  # one partition of the benchmark at a time
        n = text.count(" ") + 1
        if held and size + n > most_words:
            yield held
            held, size = [], 0
        held.append((item, text.encode()))
        size += n
    if held:
        yield held


def _scan(shared):
    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            n_words, found_ranges, items = [], [], []
            for text in texts(batch.column(2)):
                found = words(text)
                ranges, names = matcher.scan(found)
                n_words.append(len(found))
                found_ranges.append([x for r in ranges for x in r])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    batch.column(3),
                    pa.array(n_words, pa.int64()),
                    pa.array(found_ranges, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc", "row_key", "key", "n_words", "ranges", "items"],
            )

    return run


SCANNED = "doc long, row_key int, key long, n_words long, ranges array<int>, items array<string>"


def union(ranges: list[int]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges that cover the given ones (starts and ends in turn)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finish(batches):
    for batch in batches:
        ranges = [union(r) for r in batch.column(4).to_pylist()]
        items = [sorted(set(x)) for x in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:4],
                pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
                pa.array([[x for ab in r for x in ab] for r in ranges], pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["doc", "row_key", "key", "n_words", "n_hit", "ranges", "items"],
        )


def scanned(docs: DataFrame, benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``doc, row_key, key, n_words, n_hit, ranges, items`` of every row; ``ranges`` are starts and ends in words."""
    spark = docs.sparkSession
    texts_of = keyed(docs)
    parts = [
        texts_of.mapInArrow(_scan(spark.sparkContext.broadcast(block)), SCANNED)
        for block in item_blocks(benchmark, most_words)
    ] or [texts_of.mapInArrow(_scan(spark.sparkContext.broadcast([])), SCANNED)]
    if len(parts) == 1:
        both = parts[0]
    else:  # every block sees every row; identical rows stay apart by their number
        number = Window.partitionBy(*ROW).orderBy("n_words")
        both = reduce(DataFrame.unionAll, [p.withColumn("copy", F.row_number().over(number)) for p in parts])
        both = both.groupBy(*ROW, "copy").agg(
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("ranges")).alias("ranges"),
            F.flatten(F.collect_list("items")).alias("items"),
        ).drop("copy")
    return both.mapInArrow(
        _finish, "doc long, row_key int, key long, n_words long, n_hit long, ranges array<int>, items array<string>"
    )


def spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``doc_id, spans`` of contaminated rows: offsets of the hits in the original text."""
    place = F.udf(lambda text, r: offsets(text, list(zip(r[::2], r[1::2], strict=True))), "array<struct<start: int, end: int>>")
    rows = keyed(docs).join(hits.where(F.col("n_hit") > 0).select(*ROW, "ranges").distinct(), ROW)
    return rows.select(real_id(F.col("doc")).alias("doc_id"), place("text", "ranges").alias("spans"))


def _free(shared):
    """A filter for texts without any window of a block of items."""

    @F.pandas_udf("boolean")
    def free(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Matcher(shared.value).scan
        for column in columns:
            yield pd.Series([not scan(words((x or "").encode()))[0] for x in column], dtype=bool)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, one filter for each block of items."""
    for block in item_blocks(benchmark, most_words):
        docs = docs.where(_free(docs.sparkSession.sparkContext.broadcast(block))("text"))
    return docs


def op7_decontamination(spark, sf_dir):
    hits = scanned(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        real_id(F.col("doc")).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
