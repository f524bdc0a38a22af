"""Line de-duplication: repeated lines go, all but those of the last document that holds them.

Method: line hashes are range-partitioned with a secondary sort by document (largest id first) and position; each
range is streamed once, and the first document of a hash keeps its lines. What comes back per document is a
compressed bitmap of the lines to keep, not text.

Defined cases: null or empty text is one empty line; several rows with one id count as one document; rows without a
dropped line have a null bitmap; repeated rows lose the same lines; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import ROW, documents, keyed, real_id, texts
from repoaudit.llm.groups import ROWS, shared

SPACE = b" \t\n\x0b\x0c\r"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(least: int):
    def run(batches):
        for batch in batches:
            hi, lo, doc, slot, row = [], [], [], [], []
            ids, keys, rows = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for d, r, text, key64 in zip(ids, keys, texts(batch.column(2)), rows, strict=True):
                base = r << 32
                for pos, line in enumerate(text.lower().split(b"\n")):
                    if len(line) >= least and _long_enough(key := line.strip(SPACE), least):
                        h = xxhash.xxh3_128_intdigest(key)
                        hi.append(h >> 64)
                        lo.append(h & (2**64 - 1))
                        doc.append(~d)
                        slot.append(base | pos)
                        row.append(key64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(hi, np.uint64).view(np.int64)),
                    pa.array(np.array(lo, np.uint64).view(np.int64)),
                    pa.array(np.array(doc, np.int64)),
                    pa.array(np.array(slot, np.int64)),
                    pa.array(np.array(row, np.int64)),
                ],
                names=["hi", "lo", "doc", "slot", "key"],
            )

    return run


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for gone in batch.column(3).to_pylist():
            bits = np.ones(max(gone) // 8 * 8 + 8, bool)  # whole bytes
            bits[gone] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(maps, pa.binary())], names=["doc", "row_key", "key", "keep"]
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc, row_key, key, keep``: a compressed bitmap (1: keep) over the lines of each document that loses any.

    Lines behind the end of the bitmap stay.
    """
    found = keyed(docs).mapInArrow(_hashes(min_chars), ROWS)
    gone, _ = shared(found, "lines", min_docs)
    return (
        gone.groupBy(
            F.bitwise_not("doc").alias("doc"),
            F.shiftright("slot", 32).cast("int").alias("row_key"),
            "key",
        )
        .agg(F.collect_list(F.col("slot").bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias("gone"))
        .mapInArrow(_bitmaps, "doc long, row_key int, key long, keep binary")
    )


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, list[bytes]]:
    """Number of lines of a text, and the lines that its bitmap keeps."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()[: len(lines)]
    return len(lines), [x for x, k in zip(lines, bits, strict=False) if k] + lines[len(bits) :]


def with_bitmaps(docs: DataFrame, **rules) -> DataFrame:
    """``doc, row_key, text, keep`` of every row."""
    return keyed(docs).join(keep_bitmaps(docs, **rules), ROW, "left")


def _digests(batches):
    for batch in batches:
        n, gone, sha = [], [], []
        for text, keep in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            total, left = kept_lines(text, keep)
            n.append(total)
            gone.append(total - len(left))
            sha.append(hashlib.sha256(b"\n".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op2_line_dedup(spark, sf_dir):
    rows = with_bitmaps(documents(spark, sf_dir)).select(real_id(F.col("doc")).alias("doc_id"), "text", "keep")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
