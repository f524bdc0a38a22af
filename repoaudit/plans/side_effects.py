"""Distributed side effects: commit/send order, outbox, retries, consumers, repository gaps, verdict."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.regex import bank, fold, has_any, jvm, strip
from repoaudit.functions.text import first_match_line, line_array, line_at
from repoaudit.operators.findings import expand, finding, per_repo, severity_counts, union_findings
from repoaudit.operators.windows import window_starts
from repoaudit.rules import side_effects as R
from repoaudit.schemas import FINDING
from repoaudit.session import stage
from repoaudit.sources.corpus import repositories, select_surface


def make(category: str, severity: str, confidence: str, line: Column, evidence: Column, gate: str) -> Column:
    return finding(category, severity, confidence, R.TITLES[category], line, evidence, merge_gate=gate)


#: A call whose parenthesis stands on a later line: what its line ends with, for each bank that has calls.
CALL = r"\s*\("
TAILS = {k: bank(*(p.removesuffix(CALL) + r"\s*\z" for p in b.patterns if p.endswith(CALL)), ignore_case=True) for k, b in (("retry", R.RETRY), ("effect", R.EFFECT))}


def block_signals(lines: Column) -> Column:
    """What every ten lines of a file hold: the first hit of each bank, and where calls end that begin in them.

    Each line is matched once. A bank that the whole text does not hold is not looked for again.
    """
    size = F.lit(R.WINDOW_STEP)

    def opens_after(n: Column) -> Column:
        """The line after line ``n`` on which a call goes on, if a window can still hold both."""
        later = F.transform(
            F.slice(lines, n + 1, F.lit(R.WINDOW_LINES - 1)),
            lambda x, j: F.when(x.rlike(jvm(r"\S")), F.struct((n + j + 1).alias("at"), x.rlike(jvm(r"^\s*\(")).alias("opens"))),
        )
        next_line = F.array_min(later)
        return F.when(next_line["opens"], next_line["at"])

    def one(start: Column) -> Column:
        part = F.slice(lines, start + 1, size)
        first = lambda rules: F.array_min(F.transform(part, lambda x, i: F.when(has_any(x, rules), start + i + 1)))
        held = lambda rules: F.exists(part, lambda x: has_any(x, rules))
        ends = lambda k: F.array_min(F.transform(part, lambda x, i: F.when(has_any(x, TAILS[k]), opens_after(start + i + 1))))
        if_any = lambda flag, value: F.when(F.col(flag), value)
        return F.struct(
            if_any("commit", first(R.COMMIT)).alias("commit"),
            first(R.EFFECT).alias("effect"),
            if_any("retry", first(R.RETRY)).alias("retry"),
            F.coalesce(if_any("flag_outbox", held(R.OUTBOX)), F.lit(False)).alias("outbox"),
            F.coalesce(if_any("flag_idempotency", held(R.IDEMPOTENCY)), F.lit(False)).alias("idempotency"),
            *[if_any("split_calls", ends(k)).alias(f"{k}_ends") for k in TAILS],
        )

    return F.transform(window_starts(lines, R.WINDOW_STEP), one)


def window_signals(blocks: Column) -> Column:
    """First hits and rule outcomes of every 40-line window (step 10), from the blocks that it is made of."""

    def one(block: Column, i: Column) -> Column:
        inside = [F.get(blocks, i + k) for k in range(R.WINDOW_LINES // R.WINDOW_STEP)]
        start = i * R.WINDOW_STEP
        commit, effect, retry = (F.least(*(b[k] for b in inside)) for k in ("commit", "effect", "retry"))
        held = lambda k: F.greatest(*(F.coalesce(b[k], F.lit(False)) for b in inside))
        split = lambda k: F.coalesce(F.least(*(b[f"{k}_ends"] for b in inside)) <= start + R.WINDOW_LINES, F.lit(False))
        both = commit.isNotNull() & effect.isNotNull()
        dual = both & (effect >= commit)
        retried = (retry.isNotNull() | split("retry")) & (effect.isNotNull() | split("effect")) & ~held("idempotency")
        return F.struct(
            commit.alias("commit"), effect.alias("effect"), F.coalesce(retry, start + 1).alias("retry"),
            (both & (effect < commit)).alias("early"), dual.alias("dual"), (dual & ~held("outbox")).alias("no_outbox"), retried.alias("retried"),
        )

    return F.transform(blocks, one)


def window_findings(lines: Column, windows: Column) -> Column:
    """Ordering findings of one file, as one array in order of windows.

    A line is in four windows at most, so a finding is new where none of the three windows before gave it.
    """
    none = F.lit(None).cast(FINDING)

    def one(w: Column, i: Column) -> Column:
        text = lambda key: strip(line_at(lines, w[key]))

        def fresh(flag: str, key: str) -> Column:
            earlier = [F.get(windows, i - k) for k in range(1, R.WINDOW_LINES // R.WINDOW_STEP)]
            return w[flag] & ~reduce(or_, (F.coalesce(x[flag] & (x[key] == w[key]), F.lit(False)) for x in earlier))

        ordering = (
            F.when(
                fresh("early", "effect"),
                make("pre-commit-side-effect", "critical", "high", w["effect"], F.array(text("effect"), text("commit")), "block-now"),
            )
            .when(
                fresh("dual", "commit"),
                make("dual-write-hazard", "high", "high", w["commit"], F.array(text("commit"), text("effect")), "block-now"),
            )
            .otherwise(none)
        )
        outbox = F.when(
            fresh("no_outbox", "commit"),
            make(
                "outbox-gap", "high", "medium", w["commit"],
                F.array(
                    F.lit("commit + side effect detected"),
                    F.lit("no local outbox / relay keyword detected in the surrounding flow"),
                ),
                "block-changed-files",
            ),
        ).otherwise(none)
        retry = F.when(
            fresh("retried", "retry"), make("unsafe-retry", "high", "medium", w["retry"], F.array(text("retry")), "block-changed-files")
        ).otherwise(none)
        return F.filter(F.array(ordering, outbox, retry), lambda f: f.isNotNull())

    return F.flatten(F.transform(windows, one))


def file_signals(files: DataFrame) -> DataFrame:
    """The single pass over file texts: repository flags, relevance and candidate findings."""
    src = select_surface(files, "distributed-side-effects").where(F.col("text") != "")
    src = src.withColumn("low", fold(F.col("text")))
    text, low = F.col("text"), F.col("low")
    flags = src.select(
        "repo_id",
        "path",
        "low",
        line_array(text).alias("lines"),
        has_any(text, R.EFFECT, low).alias("effect"),
        has_any(text, R.COMMIT, low).alias("commit"),
        has_any(text, R.CONSUMER, low).alias("consumer"),
        has_any(text, R.MUTATION, low).alias("mutation"),
        has_any(text, R.RETRY, low).alias("retry"),
        text.rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]\s*\(").alias("split_calls"),
        *[has_any(text, b, low).alias(f"flag_{k}") for k, b in R.FLAG_BANKS.items()],
    )
    lines = F.col("lines")
    none = F.array().cast(f"array<{FINDING.simpleString()}>")
    worth = F.col("effect") & (F.col("commit") | F.col("retry"))
    # each step is a column of its own: inlined into the next, it would be computed again for every window
    hits = flags.withColumn("blocks", F.when(worth, block_signals(lines))).withColumn("windows", window_signals(F.col("blocks")))
    words = lambda names, c: _any_word(c, names)
    consumer_at = F.coalesce(first_match_line(lines, R.CONSUMER), first_match_line(lines, R.MUTATION), F.lit(1))
    guarded = ~F.col("flag_idempotency") & F.col("mutation") & (
        F.col("consumer") | words(R.CONSUMER_PATH_WORDS, F.lower("path"))
    )
    return hits.select(
        "repo_id",
        "path",
        "effect",
        *[f"flag_{k}" for k in R.FLAG_BANKS],
        (F.col("effect") | F.col("commit") | F.col("consumer") | words(R.RELEVANT_WORDS, low)).alias("relevant"),
        F.concat(
            F.coalesce(window_findings(lines, F.col("windows")), none),
            F.when(
                guarded,
                F.array(
                    make(
                        "idempotency-gap", "high", "medium", consumer_at,
                        F.array(strip(line_at(lines, consumer_at))), "block-changed-files",
                    )
                ),
            ).otherwise(none),
        ).alias("found"),
    )


def _any_word(col: Column, words: list[str]) -> Column:
    out = col.contains(words[0])
    for w in words[1:]:
        out = out | col.contains(w)
    return out


def repo_flags(signals: DataFrame) -> DataFrame:
    """Flags per repository over whole texts; combined map-side, so a huge repository is no hot spot."""
    return signals.groupBy("repo_id").agg(
        *[F.bool_or(f"flag_{k}").alias(k) for k in R.FLAG_BANKS],
        F.bool_or("effect").alias("has_effect"),
        F.count_if("relevant").alias("relevant_signals"),
        F.count(F.lit(1)).alias("files_scanned"),
    )


def detect_from_signals(signals: DataFrame, flags: DataFrame) -> DataFrame:
    """File findings with the repository-wide exceptions applied, plus repository gaps.

    Only the narrow finding rows meet the flags, never the texts.
    """
    rows = expand(signals, F.col("found"))
    excused = (F.col("category") == "outbox-gap") & F.col("outbox") | (
        (F.col("category") == "idempotency-gap") & F.col("idempotency")
    )
    kept = rows.join(flags.select("repo_id", "outbox", "idempotency"), "repo_id").where(~excused).drop(
        "outbox", "idempotency"
    )
    active = (F.col("relevant_signals") > 0) & F.col("has_effect")
    gaps = per_repo(
        flags,
        F.when(
            active & ~F.col("dead_letter"),
            make(
                "dead-letter-gap", "medium", "medium", F.lit(1),
                F.array(
                    F.lit("message / handler signals detected"), F.lit("no DLQ / dead-letter keyword found repo-wide")
                ),
                "warn-only",
            ),
        ),
        F.when(
            active & ~F.col("event_versioning"),
            make(
                "event-contract-gap", "medium", "low", F.lit(1),
                F.array(
                    F.lit("event / publish signals detected"),
                    F.lit("no obvious version field or version marker found repo-wide"),
                ),
                "warn-only",
            ),
        ),
        F.when(
            active & ~F.col("observability"),
            make(
                "observability-gap", "low", "low", F.lit(1),
                F.array(
                    F.lit("side-effect signals detected"),
                    F.lit("no obvious trace_id / correlation_id / telemetry signal found repo-wide"),
                ),
                "warn-only",
            ),
        ),
    )
    return union_findings(kept, gaps)


def tool_findings(runs: DataFrame) -> DataFrame:
    """Findings from merged structural tool runs."""
    r = runs.where(F.col("status").isin("failed", "issues")).withColumn("path", F.lit("."))
    failed = F.col("status") == "failed"
    said = F.concat(F.array("summary"), "details")
    return r.select(
        "repo_id",
        "path",
        F.lit(0).alias("emit_ord"),
        F.when(
            failed,
            finding(
                "scan-blocker", "medium", "high", F.concat("tool", F.lit(" did not complete cleanly")), 1, said,
                merge_gate="warn-only",
            ),
        )
        .otherwise(
            finding(
                F.when(F.col("tool") == "ast-grep", "dynamic-dispatch-signal").otherwise("side-effect-pattern-signal"),
                "medium", "medium",
                F.concat("tool", F.lit(" reported additional distributed side-effect evidence")), 1, said,
                merge_gate="warn-only",
            )
        )
        .alias("f"),
    ).select("repo_id", "path", "emit_ord", "f.*")


def verdict() -> Column:
    positive = sum((F.col(k).cast("int") for k in R.FLAG_BANKS), F.lit(0))
    return (
        F.when(F.col("relevant_signals") == 0, "not-applicable")
        .when((F.col("critical") > 0) | (F.col("high") >= 2), "unsafe")
        .when((F.col("high") == 1) | (F.col("medium") >= 2), "fragile")
        .when(F.col("total") > 0, "watch")
        .when(positive >= 4, "hardened")
        .otherwise("sound")
    )


def audit(files: DataFrame, tool_runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and one verdict row per repository. Texts are read once."""
    signals = stage(file_signals(files), "side-effects")
    flags = repo_flags(signals)
    found = detect_from_signals(signals, flags)
    if tool_runs is not None:
        found = union_findings(found, tool_findings(tool_runs))
    counts = severity_counts(found)
    rows = (
        repositories(files)
        .join(flags, "repo_id", "left")
        .join(counts, "repo_id", "left")
        .fillna(0)
        .fillna(False)
    )
    return found, rows.withColumn("verdict", verdict())
