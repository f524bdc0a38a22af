"""Windows of the side effect audit against windows cut and matched one by one, and their growth with the file."""

from __future__ import annotations

import random
import re
import time

from repoaudit.plans import side_effects
from repoaudit.rules import side_effects as R

PIECES = [
    "x = 1", "", "   ", "publish(order)", "publish", "  (order)", "(a)", "session.commit()", "commit", "@retry", "retry (3)", "retry", "tenacity",
    "kafka", "outbox.add(o)", "relay", "if request_id: pass", "ON CONFLICT", "unique", "flush( )", "httpx.post", "send( commit( retry(", "def f():", "\t(",
]


def by_hand(text):
    """Findings in order of windows, each once: (category, line, evidence)."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    rx = {k: re.compile(getattr(R, k).regex) for k in ("COMMIT", "EFFECT", "RETRY", "OUTBOX", "IDEMPOTENCY")}
    out = []

    def add(*row):
        if row not in out:
            out.append(row)

    if not (rx["EFFECT"].search(text) and (rx["COMMIT"].search(text) or rx["RETRY"].search(text))):
        return out
    for start in range(0, len(lines), R.WINDOW_STEP):
        part = lines[start : start + R.WINDOW_LINES]
        whole = "\n".join(part)
        first = {k: next((start + i for i, x in enumerate(part, 1) if p.search(x)), None) for k, p in rx.items()}
        c, e = first["COMMIT"], first["EFFECT"]
        at = lambda n: lines[n - 1].strip()
        if c and e and e < c:
            add("pre-commit-side-effect", e, (at(e), at(c)))
        if c and e and e >= c:
            add("dual-write-hazard", c, (at(c), at(e)))
            if not rx["OUTBOX"].search(whole):
                add("outbox-gap", c, None)
        if rx["RETRY"].search(whole) and rx["EFFECT"].search(whole) and not rx["IDEMPOTENCY"].search(whole):
            n = first["RETRY"] or start + 1
            add("unsafe-retry", n, (at(n),))
    return out


def files(spark, texts):
    rows = [("r", f"src/f{i}.py", t, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_id string, path string, text string, size_bytes long")


def test_windows_against_windows_cut_one_by_one(spark):
    rng = random.Random(4)
    texts = []
    for n in (1, 9, 10, 11, 39, 40, 41, 45, 80, 130, 200) * 16:
        rare = rng.sample(PIECES, rng.randint(2, 6))
        texts.append("\n".join(rng.choice(rare) if rng.random() < 0.25 else rng.choice(("y = 2", "", "z")) for _ in range(n)) + rng.choice(("", "\n")))
    got = {r.path: r.found for r in side_effects.file_signals(files(spark, texts)).collect()}
    total = 0
    for i, text in enumerate(texts):
        rows = [
            (f.category, f.line, None if f.category == "outbox-gap" else tuple(f.evidence))
            for f in got.get(f"src/f{i}.py", [])
            if f.category != "idempotency-gap"
        ]
        assert rows == by_hand(text), text
        total += len(rows)
    assert total > 300


def test_calls_that_go_on_in_a_later_line(spark):
    """A parenthesis on the next line belongs to the window only if both lines do."""
    pad = ["y = 2"] * 38
    inside = "\n".join(["retry", "(3)", "publish", "", "  (x)", *pad])
    across = "\n".join(["@retry", *["y"] * 38, "publish", "(x)", *["z"] * 60])
    for text in (inside, across):
        found = side_effects.file_signals(files(spark, [text])).first().found
        assert [(f.category, f.line) for f in found] == [x[:2] for x in by_hand(text)]


def test_time_grows_with_the_lines(spark):
    """Ten times the lines take ten times as long, not a hundred times."""
    block = ["x = 1"] * 7 + ["publish(order)", "y = 2", "session.commit()", "@retry", "requests.post(url)", "retry", "  (x)"] + ["z = 3"] * 6

    def seconds(n):
        df = files(spark, ["\n".join((block * (n // 20 + 1))[:n])])
        start = time.perf_counter()
        found = side_effects.file_signals(df).selectExpr("size(found) AS n").first().n
        return time.perf_counter() - start, found

    seconds(2_000)  # compiled code
    small, large = min(seconds(20_000) for _ in range(2)), seconds(200_000)
    assert large[1] > 9 * small[1] and large[0] < 25 * small[0] + 1
