"""N-gram Jaccard self-join: documents whose sets of five-word shingles are similar, and their components.

Method: several global orders of the shingles. Two sets of similarity 0.8 share a shingle in the first fifth of each
under every global order. Postings of the first order (frequent shingles last, the others by hash) give candidates;
candidates must share a prefix shingle under two further orders as well, and what is left is verified on whole sets.
Before sets are built, candidates are filtered by size, by the rank of the shared shingle, and by counts of shingles in
256 ranges of their hash, whose common part is no smaller than the sets'.

Frequent shingles: those seen in at least three texts of one batch are counted, and those whose count reaches
``FREQUENT`` of all documents come last in every order. There are at most (mean set size / ``FREQUENT``) of them, at
any size of the corpus, so they may be broadcast. The choice only orders shingles; no link depends on it.

No pairs within a group of copies: equal sets are one class. A bucket of a prefix shingle first links its members with
its smallest member only; after components are known, only members of different components still meet, filtered by
size and by the rank of the shared shingle. Buckets are streams over range-sorted hashes (see ``groups``).

Large buckets of unrelated documents (a passage that many share): more shingles than the prefix are posted, so that
the shingles of buckets above ``BUCKET`` members can be moved to the end of the order once their sizes are known. A
document whose posted shingles still hold a whole prefix without them needs no pair from such a bucket. Documents that
consist mostly of such shingles are compared by their rare shingles and, as classes of equal frequent parts, by numbers
(see ``_late_pairs``). No bucket is cut, and none is paired with itself. What can still grow faster than the input are
classes: many different sets of frequent shingles that are nearly, but not quite, similar.

Defined cases: texts without words have an empty set and no links; texts of one to four words have one shingle; several
rows with one id are one document with the sets of all; a null id is one id, below all others (in ``representatives`` a row
without an id is a document of its own); an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoaudit.llm.common import NO_ID, ROW, discard, documents, keyed, real_id, stage, texts, written
from repoaudit.llm.graph import components
from repoaudit.llm.groups import ROWS, shared
from repoaudit.llm.wordhash import SECOND, mix, window_hashes, word_numbers

WORDS = 5
#: A shingle in more than this share of all documents comes last in the orders.
FREQUENT = 2e-4
#: Members of a bucket with several components whose shingle is then moved to the end of the order.
BUCKET = 24
#: Shingles posted beyond the prefix: a tenth of the set, and no fewer than these.
RESERVE = 60
PROFILE = "doc long, row_key int, key long, n long, hi long, lo long, ranges binary, count long"
SETS = "doc long, n long, hi long, lo long, tokens binary, second binary, third binary"


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    numbers = word_numbers(found)
    if len(found) >= WORDS:
        return np.unique(window_hashes(numbers, WORDS))
    return window_hashes(numbers, len(found), SECOND) + np.uint64(len(found))


def prefix_size(n: int) -> int:
    """Shingles of which a similar set must hold one, under any order: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def posted_size(n: int) -> int:
    """Shingles posted of a set: the prefix, and a reserve for those that are moved to the end of the order."""
    return min(n, prefix_size(n) + max(n // 10, RESERVE))


def ordered(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """The tokens in one of the global orders: rare ones by a hash of the order, then frequent ones by count."""
    key = tokens if order == 0 else mix(tokens, 2 * order + 0x9E3779B97F4A7C15)
    weight = np.zeros(len(tokens), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((key, weight))]


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _profile(batches):
    """Set size and fingerprint of every row; then the shingles that three texts of the batch share, with counts."""
    for batch in batches:
        sizes, hi, lo, sets, ranges = [], [], [], [], []
        for text in texts(batch.column(2)):
            tokens = shingles(text)
            mark = xxhash.xxh3_128_intdigest(tokens.tobytes())
            sizes.append(len(tokens))
            hi.append(mark >> 64)
            lo.append(mark & (2**64 - 1))
            sets.append(tokens)
            in_range = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256)
            ranges.append(np.minimum(in_range, 255).astype(np.uint8).tobytes())
        nothing = pa.nulls(len(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], batch.column(3), pa.array(sizes, pa.int64()), _signed(hi), _signed(lo), pa.array(ranges, pa.binary()), nothing],
            names=["doc", "row_key", "key", "n", "hi", "lo", "ranges", "count"],
        )
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0), np.empty(0))
        often = counts >= 3
        n = int(often.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), _signed(tokens[often]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(counts[often].astype(np.int64))],
            names=["doc", "row_key", "key", "n", "hi", "lo", "ranges", "count"],
        )


def _postings(shared_frequent):
    def run(batches):
        frequent, counts = shared_frequent.value
        for batch in batches:
            hi, doc, slot = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d, text in zip(batch.column(0).to_pylist(), texts(batch.column(2)), strict=True):
                tokens = shingles(text)
                n = len(tokens)
                if n:
                    first = ordered(tokens, frequent, counts, 0)[: posted_size(n)]
                    hi.append(first.view(np.int64))
                    doc.append(np.full(len(first), d, np.int64))
                    slot.append((np.arange(len(first), dtype=np.int64) << 32) | n)
            hi = np.concatenate(hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi), zeros := pa.array(np.zeros(len(hi), np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(slot)), zeros],
                names=["hi", "lo", "doc", "slot", "key"],
            )

    return run


def _sets(shared_frequent):
    def run(batches):
        frequent, counts = shared_frequent.value
        for batch in batches:
            rows = []
            for text in texts(batch.column(2)):
                tokens = shingles(text)
                mark = xxhash.xxh3_128_intdigest(tokens.tobytes())
                some = prefix_size(len(tokens))
                further = [np.sort(ordered(tokens, frequent, counts, k)[:some]).tobytes() for k in (1, 2)]
                rows.append((len(tokens), mark >> 64, mark & (2**64 - 1), tokens.tobytes(), *further))
            n, hi, lo, *blobs = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _signed(hi), _signed(lo), *(pa.array(b, pa.binary()) for b in blobs)],
                names=[c.split()[0] for c in SETS.split(", ")],
            )

    return run


def _spelled(batches):
    """Every shingle of every row."""
    for batch in batches:
        sets = [shingles(text) for text in texts(batch.column(2))]
        sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        spread = [np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*spread, np.repeat(sizes, sizes), every)], names=["node", "row_key", "key", "n", "hi"])


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _verify(batches):
    for batch in batches:
        keep = []
        columns = [batch.column(i).to_pylist() for i in range(2, 8)]
        for a, b, second_a, second_b, third_a, third_b in zip(*columns, strict=True):
            u64 = lambda x: np.frombuffer(x, np.uint64)
            passes = _meet(u64(second_a), u64(second_b)) and _meet(u64(third_a), u64(third_b))
            if passes:
                common = _meet(u64(a), u64(b))
                passes = 100 * common >= 80 * (len(a) // 8 + len(b) // 8 - common)
            keep.append(bool(passes))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], names=["a", "b", "linked"])


def _near(batches):
    """Pairs whose sets may be similar by the counts in hash ranges; a full count may stand for any number."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (4, 5))
        both = np.minimum(a, b)
        most = both.sum(1, dtype=np.int64)
        sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        keep = (9 * most >= 4 * sizes) | (both == 255).any(1)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))


class _Classes:
    """Classes of equal sets, and the verification of candidate pairs of them."""

    def __init__(self, docs: DataFrame, own: DataFrame, frequent):
        self.docs, self.own, self.frequent = docs, own, frequent

    def rows_of(self, nodes: DataFrame) -> DataFrame:
        """``node, row_key, text, key``: the rows of each of the nodes, a column ``end``."""
        wanted = self.own.join(nodes, F.col("node") == F.col("end"), "left_semi").select(*ROW, "node")
        return keyed(self.docs).join(wanted.distinct(), ROW).select("node", "row_key", "text", "key")

    def tokens(self, members: DataFrame) -> DataFrame:
        """``hi, node, row_key, key, n, label``: every shingle of the members' whole sets, row by row."""
        spelled = self.rows_of(members.select(F.col("node").alias("end"))).mapInArrow(_spelled, "node long, row_key int, key long, n long, hi long")
        return spelled.distinct().join(members, "node")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of the candidate pairs: by ranges of hashes, by further orders, by whole sets."""
        side = lambda k: self.own.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("ranges").alias(f"ranges_{k}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        near, near_at = written(
            sized.select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b").mapInArrow(_near, "a long, b long").distinct(), f"{name}-near"
        )
        ends = near.select("a").unionAll(near.select("b")).distinct().withColumnRenamed("a", "end")
        sets, sets_at = written(self.rows_of(ends).mapInArrow(_sets(self.frequent), SETS), f"{name}-sets")
        side = lambda k: sets.select(F.col("doc").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("tokens", "second", "third")))
        columns = [f"{c}_{k}" for c in ("tokens", "second", "third") for k in ("a", "b")]
        full = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", *columns)
        judged = full.mapInArrow(_verify, "a long, b long, linked boolean")
        links = stage(judged.where("linked").select("a", "b").distinct(), name)
        discard(self.docs.sparkSession, near_at, sets_at)
        return links


def _late_pairs(classes: "_Classes", rows: DataFrame) -> list[DataFrame]:
    """Candidates ``node_a, node_b`` of documents that consist mostly of late shingles.

    These, and the documents of a like size in the same late buckets, meet on their whole sets. Of a similar pair either
    a rare shingle is in both prefixes, under the order of their number here, and buckets of rare shingles are small; or
    all that the two share are frequent shingles. Then the numbers alone decide: documents with the same frequent part
    are one class, and a class is compared with others once, not by its members. Where a member and any document of a
    class share enough, so do that member and the smallest document of the class; hence links with smallest documents
    connect all that is linked, one for each member within its class and one in the best of the other classes.
    """
    size = F.col("slot").bitwiseAND(F.lit(2**32 - 1))
    members = rows.where("late").select("hi", "node", "label", "short", size.alias("n"))
    reach = members.where("short").groupBy("hi").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    near = members.join(reach, "hi").where("short OR (5 * n >= 4 * least AND 4 * n <= 5 * most)")
    chosen = stage(near.select("node", "label").distinct(), "late-members")
    tokens = stage(classes.tokens(chosen), "late-shingles")
    counts = tokens.groupBy("hi").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"))
    # a shingle of one component only is shared with no document of another
    counted = tokens.join(counts.where("low < high").select("hi", "c"), "hi")
    order = F.array_sort(F.collect_list(F.struct("c", "hi")))  # of one document
    sets = counted.groupBy("node", "row_key", "key", "label", "n").agg(order.alias("t")).withColumn(
        "prefix", (F.col("n") - F.expr("(4 * n + 4) div 5") + 1 - (F.col("n") - F.size("t"))).cast("int")
    )
    rare = F.filter("t", lambda x: x["c"] <= BUCKET)
    ordered_sets = stage(sets.where("prefix > 0").select("*", F.size(rare).alias("n_rare")), "late-sets")

    met = ordered_sets.select("node", "label", "n", F.explode(F.slice("t", F.lit(1), F.least("prefix", "n_rare"))).alias("x")).select("x.hi", "node", "label", "n")
    side = lambda df, p: df.select(*(F.col(c).alias(c if c == "hi" else f"{c}_{p}") for c in df.columns))
    alike = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) AND node_a < node_b"
    by_rare = side(met, "a").join(side(met, "b"), "hi").where(f"label_a <> label_b AND {alike}").select("node_a", "node_b").distinct()

    often = F.transform(F.filter("t", lambda x: x["c"] > BUCKET), lambda x: x["hi"])
    mostly = stage(ordered_sets.where("n_rare < prefix").select("node", "label", "n", often.alias("part")), "late-parts")
    smallest = F.min(F.struct("n", "node", "label")).alias("m")
    one_label = F.when(F.min("label") == F.max("label"), F.min("label")).alias("only")  # no label: its documents are of several components
    groups = stage(mostly.groupBy("part").agg(smallest, one_label).select("part", F.size("part").alias("p"), "m.*", "only"), "late-classes")
    own = mostly.join(groups.select("part", "p", F.col("n").alias("n_m"), F.col("node").alias("node_m"), F.col("label").alias("label_m")), "part")
    stars = own.where("node <> node_m AND label <> label_m AND 9 * p >= 4 * (n + n_m)").select(
        F.least("node", "node_m").alias("node_a"), F.greatest("node", "node_m").alias("node_b")
    )

    needed = F.expr("cast(p - (4 * n + 4) div 5 + 1 as int)")
    heads = groups.where(needed > 0).select("node", "n", "p", "only", F.posexplode(F.slice("part", F.lit(1), needed)).alias("at", "hi"))
    # of two components; the first shingle that a similar pair shares leaves room for all others
    apart = "NOT (only_a <=> only_b AND only_a IS NOT NULL)"
    room = "9 * least(p_a - at_a, p_b - at_b) >= 4 * (n_a + n_b)"
    found = side(heads, "a").join(side(heads, "b"), "hi").where(f"{apart} AND {alike} AND {room}").select("node_a", "node_b").distinct()
    whole = groups.select("node", "label", "n", "part")
    both = found.join(side(whole, "a"), "node_a").join(side(whole, "b"), "node_b").withColumn("o", F.size(F.array_intersect("part_a", "part_b")))
    pairs = stage(both.where("9 * o >= 4 * (n_a + n_b)").select("node_a", "node_b", "n_a", "n_b", "label_a", "label_b", "o"), "late-class-pairs")
    heard = [
        pairs.select(F.col(f"node_{x}").alias("node_m"), F.struct((9 * F.col("o") - 4 * F.col(f"n_{y}")).alias("room"), F.col(f"node_{y}").alias("to"), F.col(f"label_{y}").alias("label_to")).alias("w"))
        for x, y in ("ab", "ba")
    ]
    best = heard[0].unionAll(heard[1]).groupBy("node_m").agg(F.max("w").alias("w")).select("node_m", "w.*")
    across = own.where("node <> node_m").join(best, "node_m").where("4 * n <= room AND label <> label_to").select(
        F.least("node", "to").alias("node_a"), F.greatest("node", "to").alias("node_b")
    )
    return [by_rare, stars, pairs.where("label_a <> label_b").select("node_a", "node_b"), across]


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, row_key, key, n, node`` of every row (nodes are classes of equal sets), and ``node, label`` of linked nodes."""
    spark = docs.sparkSession
    rows = keyed(docs)
    said = stage(rows.mapInArrow(_profile, PROFILE), "shingle-profile")
    profile = said.where("count IS NULL").select(*ROW, "n", "hi", "lo", "ranges")
    total = profile.count()
    often = said.where("count IS NOT NULL").groupBy("hi").agg(F.sum("count").alias("count"))
    often = often.where(F.col("count") >= F.lit(max(3.0, FREQUENT * total))).toPandas()
    order = np.argsort(often["hi"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(
        (often["hi"].to_numpy(np.int64).view(np.uint64)[order], often["count"].to_numpy(np.int64)[order])
    )

    whole = profile.where("n > 0").withColumn("slot", F.shiftleft(F.col("row_key").cast("long"), 32))
    copies, _ = shared(whole, "equal-sets")
    copies = copies.select("doc", F.shiftright("slot", 32).cast("int").alias("row_key"), "key", "owner").distinct()
    owner = stage(copies.groupBy("doc").agg(F.min("owner").alias("owner")), "set-owner")

    def node_of(df: DataFrame, doc: str, out: str) -> DataFrame:
        owners = owner.select(F.col("doc").alias("_doc"), F.col("owner").alias("_owner"))
        return df.join(owners, F.col(doc) == F.col("_doc"), "left").withColumn(out, F.coalesce("_owner", doc)).drop("_doc", "_owner")

    joined = copies.join(owner.withColumnRenamed("owner", "node"), "doc").where("owner <> node").select(
        F.col("owner").alias("a"), F.col("node").alias("b")
    )
    single = profile.where("n > 0").join(copies.select(*ROW), ROW, "left_anti")
    own = stage(node_of(single.select(*ROW, "n", "ranges"), "doc", "node"), "set-classes")
    classes = _Classes(docs, own, frequent)

    met, met_at = shared(rows.mapInArrow(_postings(frequent), ROWS), "postings", with_owner=True)
    met = node_of(node_of(met, "doc", "node"), "owner", "first").where("node <> first OR doc = owner")
    buckets, buckets_at = written(met.select("hi", "node", "slot", "first", "owner_slot"), "buckets")
    discard(spark, met_at)

    def fits(slot_a: str, slot_b: str, *moved: str):
        """Size and rank filters of a pair that shares a shingle; ranks count less the shingles moved before them."""
        n = [F.col(s).bitwiseAND(F.lit(2**32 - 1)) for s in (slot_a, slot_b)]
        rank = [F.shiftright(s, 32) for s in (slot_a, slot_b)]
        if moved:
            rank = [F.greatest(r - F.col(m), F.lit(0)) for r, m in zip(rank, moved, strict=True)]
        rest = [k - r for k, r in zip(n, rank, strict=True)]
        return (5 * F.least(*n) >= 4 * F.greatest(*n)) & (9 * F.least(*rest) >= 4 * (n[0] + n[1]))

    def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()

    star = stage(pairs(buckets.where(fits("slot", "owner_slot")), "node", "first"), "star-pairs")
    links = classes.linked(star, "star-links").unionAll(joined)
    labels = components(links, "star")
    named = buckets.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "hi", "node", "slot", F.coalesce("label", "node").alias("label")
    )
    open_buckets = named.groupBy("hi").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high")
    left, left_at = written(
        named.join(open_buckets.select("hi", (F.col("members") > BUCKET).alias("late")), "hi").distinct(), "open-buckets"
    )
    discard(spark, buckets_at)
    late = left.where("late").groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("moved"))
    n = F.col("slot").bitwiseAND(F.lit(2**32 - 1))
    prefix = n - F.expr("(4 * (slot & 4294967295) + 4) div 5") + 1
    posted = F.least(n, prefix + F.greatest(F.expr("(slot & 4294967295) div 10"), F.lit(RESERVE)))
    moved = F.coalesce("moved", F.lit(0))
    rows, rows_at = written(
        left.join(late, F.col("node") == F.col("of"), "left").select(
            "hi", "node", "slot", "label", "late", moved.alias("moved"), (posted - moved < prefix).alias("short")
        ),
        "open-rows",
    )
    discard(spark, left_at)

    def crossed(members: DataFrame, filters) -> DataFrame:
        side = lambda p: members.select("hi", *(F.col(c).alias(f"{c}_{p}") for c in ("node", "slot", "label", "moved")))
        return side("a").join(side("b"), "hi").where((F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b")) & filters)

    # ranks in the new order are lower by no more than the number of shingles moved
    small = crossed(rows.where("NOT late"), fits("slot_a", "slot_b", "moved_a", "moved_b")).select("node_a", "node_b")
    parts = [small, *_late_pairs(classes, rows)]
    both = reduce(DataFrame.unionAll, parts)
    rest = stage(pairs(both, "node_a", "node_b").join(star, ["a", "b"], "left_anti"), "rest-pairs")
    discard(spark, rows_at)
    if rest.limit(1).count():
        second = classes.linked(rest, "rest-links")
        if second.limit(1).count():
            labels = components(links.unionAll(second), "all")
    return node_of(profile.select(*ROW, "n"), "doc", "node"), labels


def clusters(docs: DataFrame) -> DataFrame:
    """``doc, row_key, key, n_shingles, component`` of every row."""
    rows, labels = linked(docs)
    both = rows.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return both.select(*ROW, F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of the smallest id of each component; of identical rows one.

    A row without an id is a document of its own here: its text stands in for an id (62 bits of it, below all ids), so
    that near copies among such rows go as well.
    """
    own = docs.columns
    text = F.coalesce(F.col("row.text"), F.lit(""))
    stand_in = F.lit(NO_ID) + F.xxhash64(F.lit(2), text).bitwiseAND(F.lit(2**62 - 1))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("long"), stand_in).alias("doc_id"), F.col("row.text").alias("text")
    )
    kept = clusters(packed.select("doc_id", "text")).where(F.col("doc") == F.col("component")).select(*ROW).distinct()
    named = keyed(packed, "row")
    same = Window.partitionBy(*ROW).orderBy(F.lit(1))
    once = named.join(kept, ROW, "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in own))


def op4_ngram_join(spark, sf_dir):
    found = clusters(documents(spark, sf_dir))
    return found.select(
        real_id(F.col("doc")).alias("doc_id"), "n_shingles", real_id(F.col("component")).alias("component_id")
    )
