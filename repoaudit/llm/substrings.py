"""Substring de-duplication: words of long passages that an earlier document has go.

Method: difference-cover anchors. ``COVER`` is a difference cover modulo ``PERIOD``: for any two positions some shift
below the period takes both to cover positions. Only windows of ``ANCHOR`` words at cover positions are hashed; since
``ANCHOR + PERIOD - 1`` words are a passage of ``PASSAGE`` words, two equal passages share an anchor at the same place
inside them. Where a document shares anchors with another one, the passages around them are extended to full length,
hashed in 128 bits, and a passage goes where a smaller document starts it as well. A whole text is an anchor too: a
copy of a smaller document's text needs no extension.

Both rounds sort hashes over ranges (see ``groups``); no pairs are formed and no group is gathered.

Defined cases: null or empty texts have no words and keep none; texts shorter than a passage stay whole; rows with
equal ids take nothing from each other; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import ROW, discard, documents, keyed, real_id, stage, texts
from repoaudit.llm.groups import ROWS, shared
from repoaudit.llm.wordhash import SECOND, window_hashes, word_numbers

PASSAGE, PERIOD = 50, 31
ANCHOR = PASSAGE - PERIOD + 1
#: Fixed value: a perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
#: Position that stands for the whole text.
WHOLE = 2**31 - 1


def _batch(hi, lo, doc, slot, row):
    as_array = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays([as_array(x) for x in (hi, lo, doc, slot, row)], names=["hi", "lo", "doc", "slot", "key"])


def _anchors(batches):
    at_cover = np.isin(np.arange(PERIOD), COVER)
    for batch in batches:
        hi, lo, doc, slot, row = [], [], [], [], []
        ids, keys, rows = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for d, r, text, key in zip(ids, keys, texts(batch.column(2)), rows, strict=True):
            found = text.split()
            if len(found) < PASSAGE:
                continue
            hashes = window_hashes(word_numbers(found), ANCHOR)
            pos = np.flatnonzero(np.resize(at_cover, len(hashes)))
            whole = xxhash.xxh3_128_intdigest(b" ".join(found))
            ends = np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64)
            hi.append(np.r_[hashes[pos].view(np.int64), ends[:1]])
            lo.append(np.r_[np.zeros(len(pos), np.int64), ends[1:]])
            doc.append(np.full(len(pos) + 1, d, np.int64))
            slot.append((r << 32) | np.r_[pos, WHOLE])
            row.append(np.full(len(pos) + 1, key, np.int64))
        yield _batch(hi, lo, doc, slot, row)


def _passages(batches):
    """Hashes of the passages that hold a shared anchor."""
    for batch in batches:
        hi, lo, doc, slot, row = [], [], [], [], []
        columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
        for d, r, key, text, anchors in zip(*columns, texts(batch.column(2)), batch.column(4).to_pylist(), strict=True):
            numbers = word_numbers(text.split())
            last = len(numbers) - PASSAGE
            at = np.array(anchors, np.int64)
            edge = np.zeros(last + 2, np.int64)
            np.add.at(edge, np.minimum(np.maximum(at - (PASSAGE - ANCHOR), 0), last + 1), 1)
            np.add.at(edge, np.minimum(at, last) + 1, -1)
            pos = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            hi.append(window_hashes(numbers, PASSAGE)[pos].view(np.int64))
            lo.append(window_hashes(numbers, PASSAGE, SECOND)[pos].view(np.int64))
            doc.append(np.full(len(pos), d, np.int64))
            slot.append((r << 32) | pos)
            row.append(np.full(len(pos), key, np.int64))
        yield _batch(hi, lo, doc, slot, row)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc, row_key, key, whole, starts``: rows whose words are repeated in whole, or from these starts on."""
    row_key = F.shiftright("slot", 32).cast("int").alias("row_key")
    pos = F.col("slot").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    met, at = shared(keyed(docs).mapInArrow(_anchors, ROWS), "anchors", with_owner=True)
    per_doc = stage(
        met.groupBy("doc", row_key, "key").agg(
            F.max((pos == WHOLE) & (F.col("doc") != F.col("owner"))).alias("whole"),
            F.collect_list(F.when(pos != WHOLE, pos)).alias("anchors"),
        ),
        "anchored",
    )
    discard(docs.sparkSession, at)
    extend = per_doc.where(~F.col("whole") & (F.size("anchors") > 0)).select(*ROW, "anchors")
    rows = keyed(docs).join(extend, ROW).select("doc", "row_key", "text", "key", "anchors")
    gone, _ = shared(rows.mapInArrow(_passages, ROWS), "passages")
    starts = gone.groupBy("doc", row_key, "key").agg(F.collect_list(pos).alias("starts"))
    return per_doc.where("whole").select(*ROW, "whole", F.lit(None).cast("array<int>").alias("starts")).unionAll(
        starts.select(*ROW, F.lit(False), "starts")
    )


def kept_words(text: bytes, whole: bool | None, starts: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words of a text, and the words that stay."""
    found = text.split()
    if whole:
        return len(found), []
    if not starts:
        return len(found), found
    edge = np.zeros(len(found) + 1, np.int64)
    at = np.array(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + PASSAGE, -1)
    stays = (np.cumsum(edge[:-1]) == 0).tolist()
    return len(found), [w for w, s in zip(found, stays, strict=True) if s]


def _digests(batches):
    for batch in batches:
        n, gone, sha = [], [], []
        for text, whole, starts in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            total, left = kept_words(text, whole, starts)
            n.append(total)
            gone.append(total - len(left))
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def op9_substring_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = keyed(docs).join(repeated_passages(docs), ROW, "left")
    rows = rows.select(real_id(F.col("doc")).alias("doc_id"), "text", "whole", "starts")
    return rows.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
