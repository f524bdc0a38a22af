"""Token ids in ORC files: integer run lengths, row indexes and Bloom filters on document ids.

Every text is encoded by the vocabulary's own library, an end id is appended, and rows are range-sorted by document
id, one file per range. A row holds its ids, its place within its file and its file's number, so that the place of
a document in the whole sequence follows from one short sum per file. Readers split files by stripe; a look-up by id
prunes files and stripes by their statistics and Bloom filters.

Texts are cut into chunks (see ``chunks``) by Arrow, a batch of texts at a time; each distinct chunk of a batch is looked
up once, and its pieces are encoded once while a worker remembers them. A text with a special string inside is encoded whole.

Defined cases: a null or empty text is the end id alone; rows with null ids come first; rows with equal ids follow
each other in text order, each with a place of its own; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoaudit.llm.chunks import OTHER_WHITE, Chunked, byte_letters
from repoaudit.llm.common import documents, narrow_batches, stage_path

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
ROWS = "doc_id long, part int, place long, n_tokens long, ids array<int>"
#: Texts whose chunks are held at once; a batch has few texts if they are long.
PART_ROWS = 1024
#: Begin a chunk that no space precedes: the head of a text, its end id, the number of a text encoded by itself.
HEAD, END, WHOLE = "\x1c", "\x1d", "\x1e"
#: White space that a cut at every space and line feed would tear apart, and the characters above.
UNEVEN = f"[\t\x0b\x0c\r\x1c-\x1f{OTHER_WHITE}]|  | \n|\n\n| \\z"


class Encoder:
    """Ids of texts as little-endian 32-bit integers, by the vocabulary's library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.plain = Chunked(self._piece, b"".join)
        self.packed = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]
        self.by_itself = "|".join([UNEVEN, *map(re.escape, self.special)])

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            letters = self.space + piece[1:]
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.lib.model.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        return self.plain(text)

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and how many ids each text has."""
        wide = pa.large_string()
        texts = texts.cast(wide).fill_null("")
        alone = pc.match_substring_regex(texts, self.by_itself)
        none, head, tail = (pa.scalar(x, wide) for x in ("", HEAD, f" {END}"))
        numbers = pa.array([f"{WHOLE}{i}" for i in range(len(texts))], wide)
        framed = pc.binary_join_element_wise(head, pc.replace_substring(texts, "\n", " \n"), tail, none)
        cut = pc.split_pattern(pc.if_else(alone, numbers, framed), " ")
        found = cut.flatten().dictionary_encode()
        words, pieces, other = self.plain.words, self.plain.words.pieces, self.plain.words.other

        def marked(chunk: str) -> bytes:
            first, rest = chunk[0], chunk[1:]
            if first == "\n":
                return other[first] + other[rest] if rest.isalpha() else pieces(chunk)
            if first == HEAD:
                return pieces(rest)
            return end if first == END else self.encode(texts[int(rest)].as_py()) + end

        known = [words[c] if c[0] > " " else marked(c) for c in found.dictionary.to_pylist()]
        values = pa.array(known, pa.large_binary()).take(found.indices)
        _, offsets, data = values.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(values) + 1) // 4
        starts = bounds[np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)]]
        return np.frombuffer(data, "<i4", int(starts[-1])) if len(values) else np.empty(0, "<i4"), np.diff(starts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that later tasks find its memory filled."""
    return Encoder(path)


def _encoded(vocabulary: str, end_id: int):
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode_all, part, place = encoder(public_tokenizers.path(vocabulary)).encode_all, TaskContext.get().partitionId(), 0
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            ids, sizes = encode_all(batch.column(1), end)
            starts = np.r_[0, np.cumsum(sizes)]
            rows = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(place + starts[:-1]),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "part", "place", "n_tokens", "ids"],
            )
            yield from (rows.slice(at, 256) for at in range(0, len(sizes), 256))
            place += int(starts[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of every row to ORC files below ``path``, in ascending document order."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text"
    )
    (
        ranged.mapInArrow(_encoded(vocabulary, end_id), ROWS)
        .write.option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; a filter on ``doc_id`` prunes files and stripes."""
    rows = spark.read.schema(ROWS).orc(path)
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = ends.select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids"
    )


def _digests(batches):
    for batch in batches:
        ids = batch.column(3)
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Write, read back, and say of every row where its ids stand and what they are."""
    write_tokens(docs, path)
    rows = read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_output(spark, sf_dir):
    return token_digests(documents(spark, sf_dir), stage_path(spark, "token-ids"))
