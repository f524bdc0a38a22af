"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density of a fixed lexicon of insults, of insults near a second-person word, of obfuscated insults
(symbols or digits for letters), of capitals and of punctuation, the number of words, and densities of a lexicon that
is learned from labelled training rows: words and word beginnings that toxic texts use far more often than others.
Trees and calibration are fitted on training rows only, at most ``MOST_ROWS`` of them, chosen by a hash of the id.

Never inputs of a score: labels, languages, sources and ids. Training rows are those whose crc32 of the id modulo
three is not one.

Defined cases: null or empty texts have all densities zero and get a score like any other text; without both labels
among the training rows every score is the share of toxic rows (0 without rows); rows without an id are never
training rows; of labels repeated for one id the largest counts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoaudit.llm.common import documents, narrow_batches, stage

#: Labelled rows that a model is fitted on, at most.
MOST_ROWS = 30_000
#: A learned term: texts of toxic rows that hold it, and how much more often toxic texts use it (natural log).
LEAST_TEXTS, LEAST_ODDS, MOST_TERMS = 3, 2.0, 5_000
BEGINNINGS = (4, 6)
#: Scores from here on are rejected.
LIMIT = 0.7
#: Insults and second-person words of four languages.
INSULTS = frozenset(
    b"idiot idiots idiotic moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown clowns "
    b"garbage filth vermin imbecile cretin jerk creep coward degenerate dimwit halfwit nitwit fool fools ugly lowlife "
    b"parasite scumbag pig swine rat bastard shit fuck fucking asshole bitch whore slut dickhead douchebag prick "
    b"dummkopf trottel vollidiot schwachkopf arschloch abschaum drecksau imb\xc3\xa9cile cr\xc3\xa9tin connard abruti salaud "
    b"ordure est\xc3\xbapido imb\xc3\xa9cil cabr\xc3\xb3n gilipollas escoria basura".split()
)
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta t\xc3\xba ti usted ustedes vuestro".split())
NEAR = 5
PUNCTUATION = b"!?"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Symbols and digits that stand for letters; other symbols inside a word are left out.
LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")
INNER = b"*.-_#+^~"
EDGES = b".,;:!?\"'()[]{}<>#*%&=|-_/"
FEATURES = ("insults", "insults_near_you", "obfuscated", "capitals", "punctuation", "log_words", "learned", "learned_weight", "learned_kinds")


def terms(word: bytes) -> list[bytes]:
    """What the learned lexicon may hold of a word: itself, and its beginnings marked with a star."""
    letters = word.decode("utf-8", "replace")
    return [word, *((letters[:n] + "*").encode() for n in BEGINNINGS if len(letters) > n)]


def obfuscated(text: bytes, plain: set[bytes]) -> int:
    """Occurrences of words that become an insult when symbols are read as letters, and are none as they stand."""
    if not any(c in text for c in b"013457@$*-_.+^~"):
        return 0
    hits = 0
    for word, n in Counter(text.lower().split()).items():
        core = word.strip(EDGES)
        if len(core) > 2 and not core.isalpha() and core not in plain:
            read = core.translate(LEET, INNER)
            hits += n * (read != core and read in INSULTS)
    return hits


class Features:
    """Dense features of texts, given the weights of learned terms."""

    def __init__(self, learned: dict[bytes, float]):
        self.learned = learned
        self.words: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        value = self.words.get(word)
        if value is None:
            if len(self.words) > 150_000:
                self.words.clear()
            value = self.words[word] = max((self.learned.get(t, 0.0) for t in terms(word)), default=0.0)
        return value

    def of(self, text: bytes) -> list[float]:
        found = text.translate(FOLD).split()
        n = max(len(found), 1)
        kinds = set(found)
        insults = near = 0
        if not kinds.isdisjoint(INSULTS):
            at = [i for i, w in enumerate(found) if w in INSULTS]
            insults = len(at)
            near = sum(not SECOND_PERSON.isdisjoint(found[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(text) - len(text.translate(None, PUNCTUATION))
        weights = [w for w in map(self.weight, found) if w] if self.learned else []
        learned_kinds = sum(1 for k in kinds if self.weight(k)) if weights else 0
        return [
            insults / n,
            near / n,
            obfuscated(text, kinds) / n,
            upper / max(len(text), 1),
            marks / n,
            math.log1p(len(found)),
            len(weights) / n,
            sum(weights) / n,
            min(learned_kinds, 20),
        ]


def features(text: Column, learned) -> Column:
    @F.pandas_udf("array<double>")
    def dense(column: pd.Series) -> pd.Series:
        of = Features(learned.value).of
        return pd.Series([of((x or "").encode()) for x in column])

    return dense(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most about ``most`` labelled rows, the same ones in every run."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(known, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"))


def _uses(batches):
    """Term, uses in toxic and in other texts, and toxic texts that hold it, summed over a batch."""
    for batch in batches:
        count: dict[bytes, list[int]] = {}
        words = [0, 0]
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            side = 0 if toxic else 1
            own: dict[bytes, int] = {}
            for word in text.encode().translate(FOLD).split():
                own[word] = own.get(word, 0) + 1
            words[side] += sum(own.values())
            held: dict[bytes, int] = {}
            for word, n in own.items():
                for t in terms(word):
                    held[t] = held.get(t, 0) + n
            for t, n in held.items():
                at = count.setdefault(t, [0, 0, 0])
                at[side] += n
                at[2] += side == 0
        count[b""] = [*words, 0]
        keys = list(count)
        columns = np.array([count[k] for k in keys], np.int64).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *map(pa.array, columns)], names=["term", "toxic", "other", "texts"]
        )


def learn_terms(rows: DataFrame) -> dict[bytes, float]:
    """Weights of the terms that toxic training texts use far more often than the others."""
    uses = rows.select("text", "toxic").mapInArrow(_uses, "term binary, toxic long, other long, texts long")
    uses = stage(uses.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "texts"))), "term-uses")
    of_toxic, of_other = uses.where(F.length("term") == 0).select("toxic", "other").first() or (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (of_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (of_other + 1.0))
    chosen = (
        uses.where((F.length("term") > 0) & (F.col("texts") >= LEAST_TEXTS))
        .select("term", odds.alias("odds"), "toxic")
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "term")
        .limit(MOST_TERMS)
        .collect()
    )
    return {bytes(r["term"]): r["odds"] for r in chosen}


class Model:
    """Fitted features, trees and calibration; ``score`` adds a column to any table with texts."""

    def __init__(self, learned, trees, calibration, rate: float):
        self.learned, self.trees, self.calibration, self.rate = learned, trees, calibration, rate

    def score(self, docs: DataFrame, out: str) -> DataFrame:
        """``docs`` with the calibrated score of every row under a name that it does not have yet."""
        if self.trees is None:
            return docs.withColumn(out, F.lit(self.rate))
        own = [c for c in docs.columns]
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
        dense = packed.withColumn("features", array_to_vector(features(F.col("row.text"), self.learned)))
        raised = self.trees.transform(dense).select("row", vector_to_array("probability")[1].alias("raw"))
        scored = self.calibration.transform(raised).select(
            *(F.col(f"row.`{c}`").alias(c) for c in own),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))).alias(out),
        )
        return scored


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    spark = docs.sparkSession
    narrow_batches(spark)
    rows = stage(training_rows(docs, labels, most), "toxicity-rows")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    learned = learn_terms(rows)
    shared = spark.sparkContext.broadcast(learned)
    if not 0 < toxic < n:
        return Model(shared, None, None, toxic / n if n else 0.0)
    dense = stage(rows.select("doc_id", F.col("toxic"), features(F.col("text"), shared).alias("dense")), "toxicity-features")
    ready = dense.orderBy("doc_id", "toxic", "dense").select("toxic", array_to_vector("dense").alias("features")).coalesce(8)
    trees = GBTClassifier(
        labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=7
    ).fit(ready)
    raised = trees.transform(ready).select("toxic", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="calibrated").fit(raised)
    return Model(shared, trees, calibration, toxic / n)


def accepted(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose score is below the limit."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return fit(docs, labels).score(docs, name).where(F.col(name) < limit).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, "score").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )
