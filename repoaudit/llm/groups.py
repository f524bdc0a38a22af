"""Streams over range-sorted hashes: which rows share a hash with another document, and with which one first.

Rows ``(hi, lo, doc, slot, key)`` are range-partitioned and sorted by the first four columns (``key`` tells rows of one
document apart and only travels along), so that the rows of one hash lie
together with the smallest ``doc`` (its owner) in front. A task streams its range in batches and holds back no more
than the rows of a group's first documents. A frequent hash is cut into several ranges by the secondary sort; the
groups at the two ends of a range are left open, and their short summaries (at most two groups of a few rows from
every range, which the driver may hold) decide the open rows afterwards. No group is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import discard, written

ROWS = "hi long, lo long, doc long, slot long, key long"
DECIDED, OPEN, SUMMARY = 0, 1, 2
OUT = "doc long, slot long, owner long, owner_slot long, hi long, lo long, kind byte, key long"


class _Group:
    """The group at the end of what has been read."""

    def __init__(self, key, is_open):
        self.key, self.open = key, is_open
        self.docs: list[int] = []
        self.slots: list[int] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _stream(min_docs: int, with_owner: bool):
    def rows(doc, slot, own, owner, owner_slot, key, kind=DECIDED):
        full = lambda v, t=np.int64: v if isinstance(v, np.ndarray) else np.full(len(doc), v, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc, slot, full(owner), full(owner_slot), full(key[0]), full(key[1]), full(kind, np.int8), own)],
            names=["doc", "slot", "owner", "owner_slot", "hi", "lo", "kind", "key"],
        )

    def decided(doc, slot, own, group):
        keep = slice(None) if with_owner else doc != group.docs[0]
        return rows(doc[keep], slot[keep], own[keep], group.docs[0], group.slots[0], group.key)

    def feed(group: _Group, doc, slot, own):
        """More rows of the group; what can be said about them now."""
        if group.open or len(group.docs) < min_docs:
            for i in np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[: min_docs + 1]:
                if len(group.docs) < min_docs and (not group.docs or doc[i] != group.docs[-1]):
                    group.docs.append(int(doc[i]))
                    group.slots.append(int(slot[i]))
        if group.open:
            yield rows(doc, slot, own, 0, 0, group.key, OPEN)
        elif len(group.docs) >= min_docs:
            for held in [*group.held, (doc, slot, own)]:
                yield decided(*held, group)
            group.held = []
        else:
            group.held.append((doc, slot, own))

    def summary(group: _Group):
        docs = np.array(group.docs, np.int64)
        yield rows(docs, np.array(group.slots, np.int64), np.zeros(len(docs), np.int64), 0, 0, group.key, SUMMARY)

    def run(batches):
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, doc, slot, own = (batch.column(i).to_numpy() for i in range(5))
            n = len(hi)
            turn = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            starts = np.r_[0, np.flatnonzero(turn) + 1]
            first_end, last = (starts[1] if len(starts) > 1 else n), starts[-1]
            ends = {(0, first_end), (last, n)}
            for a, b in sorted(ends):
                key = (int(hi[a]), int(lo[a]))
                if group is None or group.key != key:
                    if group is not None and group.open:
                        yield from summary(group)
                    group = _Group(key, group is None)
                if a and first_end < last:  # the whole groups between the two ends, once
                    inner = starts[1:-1]
                    d = doc[first_end:last]
                    sizes = np.diff(np.r_[inner, last])
                    new = np.r_[True, turn[first_end : last - 1] | (d[1:] != d[:-1])]
                    many = np.add.reduceat(new.astype(np.int64), inner - first_end) >= min_docs
                    keep = np.repeat(many, sizes)
                    owner, owner_slot = np.repeat(doc[inner], sizes), np.repeat(slot[inner], sizes)
                    if not with_owner:
                        keep &= d != owner
                    if keep.any():
                        at = np.flatnonzero(keep) + first_end
                        yield rows(doc[at], slot[at], own[at], owner[keep], owner_slot[keep], (hi[at], lo[at]))
                yield from feed(group, doc[a:b], slot[a:b], own[a:b])
        if group is not None:
            yield from summary(group)
            if not group.open:
                for held in group.held:
                    yield rows(*held, 0, 0, group.key, OPEN)

    return run


def _close(known, with_owner: bool):
    """Decide the open rows by the summaries of all ranges."""

    def run(batches):
        firsts = known.value
        for batch in batches:
            doc, slot, owner, owner_slot, hi, lo, kind, own = (batch.column(i).to_numpy() for i in range(8))
            keep = kind == DECIDED
            late = np.flatnonzero(~keep)
            if len(late):
                keep, owner, owner_slot = keep.copy(), owner.copy(), owner_slot.copy()
                turn = np.r_[True, (hi[late[1:]] != hi[late[:-1]]) | (lo[late[1:]] != lo[late[:-1]])]
                starts = np.flatnonzero(turn)
                for a, b in zip(starts, np.r_[starts[1:], len(late)], strict=True):
                    first = firsts.get((int(hi[late[a]]), int(lo[late[a]])))
                    if first:
                        at = late[a:b]
                        keep[at] = with_owner | (doc[at] != first[0])
                        owner[at], owner_slot[at] = first
            columns = [pa.array(c[keep]) for c in (hi, lo, doc, slot, own, owner, owner_slot)]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "doc", "slot", "key", "owner", "owner_slot"])

    return run


def shared(found: DataFrame, name: str, min_docs: int = 2, with_owner: bool = False) -> tuple[DataFrame, str]:
    """``hi, lo, doc, slot, key, owner, owner_slot`` of the rows whose hash at least ``min_docs`` documents hold, and the table's place.

    ``owner`` is the smallest document of the hash, ``owner_slot`` its first slot there; the owner's own rows are left out unless ``with_owner``.
    """
    spark = found.sparkSession
    rows, at = written(found.select("hi", "lo", "doc", "slot", "key"), f"{name}-rows")
    order = ["hi", "lo", "doc", "slot"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    said, place = written(ranged.mapInArrow(_stream(min_docs, with_owner), OUT), f"{name}-shared")
    discard(spark, at)
    ends = (
        said.where(F.col("kind") == SUMMARY)
        .groupBy("hi", "lo")
        .agg(F.collect_set(F.struct("doc", "slot")).alias("docs"))
        .where(F.size(F.array_distinct("docs.doc")) >= min_docs)
        .select("hi", "lo", F.array_min("docs").alias("first"))
    )
    firsts = {(r.hi, r.lo): (r.first.doc, r.first.slot) for r in ends.collect()}  # two for each range at most
    known = spark.sparkContext.broadcast(firsts)
    both = said.where(F.col("kind") != SUMMARY).mapInArrow(_close(known, with_owner), f"{ROWS}, owner long, owner_slot long")
    return both, place
