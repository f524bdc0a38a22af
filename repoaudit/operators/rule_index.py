"""Rules as a table: lines meet rules by an equi-join on words, and expressions run on what is left.

A rule's expression cannot match without one of its needles (see ``functions.regex``), and a text that holds a needle
has a word that holds the needle's longest run of letters and digits. Words are found in two steps: the distinct words
of all texts meet the runs by a key of three letters, which leaves a short table of words and rules; then the words of
each line meet that table. No rule is tried on a line without such a word, and adding a rule is adding a row.

A rule without a needle would have to be tried on every line; ``check_rules`` refuses it by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.regex import fold, jvm, needles
from repoaudit.functions.text import line_array
from repoaudit.session import stage

RULES = (
    "ord int, label string, pattern string, kind string, strength string, provider string, wrapper string, family string, "
    "sdk string, every boolean, hint string"
)
KEY = 3
WORD = "[a-z0-9]+"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for n, pattern in zip(batch["ord"], batch["pattern"], strict=True):
            found = needles(pattern)
            runs = [max(re.findall(WORD, x), key=len, default="") for x in found]
            if not found or not all(runs):
                rows.append((n, None, None, None))
            rows.extend((n, r, r[:KEY], jvm(pattern)) for r in sorted(set(runs)) if found and all(runs))
        yield pd.DataFrame(rows, columns=["ord", "run", "key", "jvm"])


def rule_runs(rules: DataFrame) -> DataFrame:
    """``ord, run, key, jvm``: a row for each needle of a rule; null runs for a rule that has none."""
    return rules.select("ord", "pattern").mapInPandas(_runs, "ord int, run string, key string, jvm string")


def check_rules(rules: DataFrame) -> DataFrame:
    """The runs of ``rules``; rules that share a number or hold no literal are refused."""
    runs = stage(rule_runs(rules), "rule-runs")
    blank = runs.where("run IS NULL").join(rules.select("ord", "label"), "ord").limit(5).collect()
    if blank:
        raise ValueError(f"rules that hold no literal of letters or digits: {sorted(r.label for r in blank)}")
    twice = rules.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"rule numbers that occur more than once: {sorted(r.ord for r in twice)}")
    return runs


def words(text: Column) -> Column:
    """Distinct runs of letters and digits of the folded text."""
    return F.filter(F.array_distinct(F.split(fold(text), "[^a-z0-9]+")), lambda w: w != "")


def keys(word: Column) -> Column:
    """All parts of a word of one to ``KEY`` letters."""

    def parts(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (k - 1))
        cut = F.transform(starts, lambda i: F.substring(word, i, F.lit(k)))
        return F.when(F.length(word) >= k, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(parts(k) for k in range(1, KEY + 1))))


def rule_words(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``word, ord, jvm``: words of the ``text`` column that hold a run of a rule."""
    vocabulary = texts.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    spelled = vocabulary.select("word", F.explode(keys(F.col("word"))).alias("key"))
    return spelled.join(runs, "key").where(F.col("word").contains(F.col("run"))).select("word", "ord", "jvm").distinct()


def matched_lines(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo_id, path, line_no, line, value, nth`` and the rule's columns, for every match of a rule in a line.

    A rule with ``every`` gives a row for each match, numbered, with the matched text; any other rule one row for a
    line that it matches, without a value.
    """
    runs = check_rules(rules)
    near = stage(rule_words(files, runs), "rule-words")
    lines = files.select("repo_id", "path", F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
    spelled = lines.select("*", F.explode(words(F.col("line"))).alias("word"))
    tried = spelled.join(near, "word").select("repo_id", "path", "pos", "line", "ord", "jvm").distinct()
    ruled = tried.join(rules, "ord")
    none = F.array().cast("array<string>")
    once = F.when(F.expr("line RLIKE jvm"), F.array(F.lit(None).cast("string"))).otherwise(none)
    values = F.when(F.col("every"), F.expr("regexp_extract_all(line, jvm, 0)")).otherwise(once)
    return ruled.select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), "line", *rules.columns, F.posexplode(values).alias("nth", "value")
    )
