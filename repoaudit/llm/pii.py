"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

Base patterns (e-mail, IP, card, phone) are matched in linear time. Nodes of the field are mentions: number-like runs
of at least seven digits and words around an at-sign, in any spelling. Its factors: features of a mention with each
label, neighbouring mentions, and skip edges between distant mentions of a text with the same letters and digits, or
the same last seven digits (each linked to the one before it, so edges grow with mentions). Labels that a base match
gives are observed; message passing carries them to repeated or similar mentions, and a mention whose label is then
sure enough becomes a span of its own, unless it touches a base span. A sweep takes the edges of a text forward and
backward once, so a label crosses any number of repeats; it is exact where edges form no loop. Each text is swept until
its messages stand still.

Factors are fitted piecewise, on the mentions of at most ``FIT_ROWS`` texts chosen by a hash. Mentions of all texts
are labelled; no text is cut.

Defined cases: a null or empty text has no spans; identical rows get identical spans; without mentions to fit on,
only base spans are returned; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoaudit.llm.common import documents, narrow_batches, stage

KINDS = ("email", "ip", "card", "phone")
#: Texts with mentions that the field is fitted on, and mentions of each, at most.
FIT_ROWS, FIT_MENTIONS = 3_000, 50
#: Least marginal probability of an added span, and the change of a message that counts as none.
SURE, STILL = 0.8, 1e-4
#: Undamped sweeps, and the factor of the step from then on, so that messages which swing around a loop come to rest.
FREE, CALM = 20, 0.9
#: Characters between neighbours, and the weight of equal labels before any pair has been seen.
NEAR, PRIOR = 200, 2.0

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9])++")
SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?(?:\(at\)|\[at\]|@) ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{1,63}){1,8})")
CUES = tuple(re.compile(p, re.I) for p in (r"mail", r"\bip\b|host|server|addr", r"card|karte|carte|tarjeta|visa", r"phone|tel|call|mobil|fax|anruf"))
N_FEATURES = 17 + len(CUES)
MENTION = "struct<start: int, end: int, label: byte, key: string, tail: string, values: array<float>>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, mentions array<{MENTION}>"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a run of local characters (behind the last match), the sign, a dotted domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, last := found.end()))
        else:
            last = at + 1  # no later match reaches over an at-sign
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of every kind, in the order of ``KINDS``."""
    none: list[tuple[int, int]] = []
    mail = emails(text) if "@" in text else none
    if not DIGIT.search(text):
        return [mail, none, none, none]
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    cards = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return [mail, ips, cards, phones]


def mentions(text: str, base: list[list[tuple[int, int]]]) -> list[dict]:
    """Nodes of the field in text order: base spans with their labels, and other mentions that touch none of them."""
    known = sorted((s, e, k + 1) for k, spans in enumerate(base) for s, e in spans)
    nodes = []
    loose = [m.span() for m in NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) >= 7] if DIGIT.search(text) else []
    if "@" in text or "(at)" in (low := text.lower()) or "[at]" in low:
        loose += [m.span() for m in SPELLED.finditer(text)]
    at = 0
    for s, e in sorted(loose):
        while at < len(known) and known[at][1] <= s:
            at += 1
        if (at == len(known) or known[at][0] >= e) and not (nodes and nodes[-1][1] > s):
            nodes.append((s, e, 0))
    out = []
    for s, e, label in sorted(nodes + known):
        part = text[s:e]
        lower = part.lower().replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".")
        digits = "".join(filter(str.isdecimal, part)) if part.isascii() else "".join(c for c in part if c in "0123456789")
        mail = "@" in lower
        n = len(digits)
        before = text[max(0, s - 30) : s]
        values = [
            1.0, mail, "." in lower.partition("@")[2], part.startswith("+"), "(" in part, part.count(".") == 3,
            part.count("-") > 1, " " in part, n < 9, 9 <= n <= 12, 13 <= n <= 15, n == 16, 17 <= n <= 19, n > 19,
            16 <= n <= 19 and luhn(digits), not mail and n == len(part), part.startswith("0"),
            *(bool(c.search(before)) for c in CUES),
        ]
        key = "".join(c for c in lower if c.isalnum() or c == "@") if mail else digits
        out.append({"start": s, "end": e, "label": label, "key": key, "tail": "" if mail else digits[-7:], "values": list(map(float, values))})
    return out


def _found(batches):
    for batch in batches:
        counts, base, nodes = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            for c, s in zip(counts, spans, strict=True):
                c.append(len(s))
            base.append([f"{k}:{s}:{e}" for k, own in zip(KINDS, spans, strict=True) for s, e in own])
            nodes.append(mentions(text or "", spans))
        kind = pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("label", pa.int8()), ("key", pa.string()), ("tail", pa.string()), ("values", pa.list_(pa.float32()))]
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(pa.string())), pa.array(nodes, pa.list_(kind))],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "mentions"],
        )


def edges(nodes: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours, and skip edges from every mention to the last one before it with the same key or tail."""
    chain = [(i, i + 1) for i, (a, b) in enumerate(pairwise(nodes)) if b["start"] - a["end"] <= NEAR]
    skip, seen = [], {}
    for i, node in enumerate(nodes):
        names = {("key", node["key"]), ("tail", node["tail"])} if node["tail"] else {("key", node["key"])}
        skip += [(j, i) for j in {seen[n] for n in names if n in seen}]
        seen |= dict.fromkeys(names, i)
    return chain, skip


def possible(x: np.ndarray) -> np.ndarray:
    """Labels that the form of a mention allows: at-signs for e-mails only, and digits as many as a kind has."""
    mail, n9, n12, n15, n16, n19 = (x[:, i] > 0 for i in (1, 8, 9, 10, 11, 12))
    few = n9 | n12
    return np.stack([np.ones(len(x), bool), mail, ~mail & few, ~mail & (n16 | n19), ~mail & (few | n15)], 1)


class Field:
    """Fitted factors: features by label, neighbours' labels, and equal labels along skip edges."""

    def __init__(self, texts: list[list[dict]], rounds: int = 300, rate: float = 0.5):
        size = len(KINDS) + 1
        x = np.array([n["values"] for t in texts for n in t], float).reshape(-1, N_FEATURES)
        y = np.array([n["label"] for t in texts for n in t], int)
        self.by_feature = np.zeros((N_FEATURES, size))
        goal = np.eye(size)[y]
        for _ in range(rounds if len(x) else 0):
            score = x @ self.by_feature
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            self.by_feature += rate * (x.T @ (goal - p) / len(x) - 1e-3 * self.by_feature)
        together, same, pairs = np.ones((size, size)), 1.0, 1.0 + np.exp(-PRIOR)
        for nodes in texts:
            chain, skip = edges(nodes)
            for i, j in chain:
                together[nodes[i]["label"], nodes[j]["label"]] += 1
            for i, j in skip:
                same += nodes[i]["label"] == nodes[j]["label"]
                pairs += 1
        joint = together / together.sum()
        self.neighbours = np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -2, 2)
        share = min(same / pairs, 0.999)
        self.alike = np.eye(size) * np.clip(np.log(share / (1 - share)), 0.5, 6)

    def marginals(self, texts: list[list[dict]]) -> np.ndarray:
        """Label probabilities of the mentions of many texts, by sum-product sweeps until the messages stand still."""
        nodes = [n for t in texts for n in t]
        x = np.array([n["values"] for n in nodes], float)
        own = np.where(possible(x), x @ self.by_feature, -30.0)
        label = np.array([n["label"] for n in nodes], int)
        seen = np.flatnonzero(label)
        own[seen] = -30.0
        own[seen, label[seen]] = 0.0
        belief = own.copy()
        ends, kind, owner, level = self._ordered(texts)
        tables = np.stack([[self.neighbours, self.alike], [self.neighbours.T, self.alike.T]])
        message = np.zeros((2, len(kind), own.shape[1]))
        live, sweep = np.arange(len(kind)), 0
        while len(live):
            step = CALM ** max(0, sweep - FREE)
            change = np.zeros(len(texts))
            for way in (0, 1):
                turn = live[np.argsort(level[way, live], kind="stable")]
                cuts = np.flatnonzero(np.diff(level[way, turn])) + 1
                for e in np.split(turn, cuts):
                    out = (belief[ends[way, e]] - message[1 - way, e])[:, :, None] + tables[way, kind[e]]
                    top = out.max(1)
                    new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                    new -= new.max(1, keepdims=True)
                    moved = step * (new - message[way, e])
                    message[way, e] += moved
                    np.add.at(belief, ends[1 - way, e], moved)
                    np.maximum.at(change, owner[e], np.abs(moved).max(1))
            live = live[change[owner[live]] > STILL]
            sweep += 1
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def _ordered(texts: list[list[dict]]) -> tuple[np.ndarray, ...]:
        """Edges as earlier and later mention, their factor and text, and the turn of each in either direction.

        An edge's turn comes after those of all edges that lead to its source, so edges of one turn are independent.
        """
        rows, offset = [], 0
        for number, t in enumerate(texts):
            chain, skip = edges(t)
            pairs = sorted([(i, j, 0) for i, j in chain] + [(i, j, 1) for i, j in skip])
            before, behind = [0] * len(t), [0] * len(t)
            for i, j, _ in pairs:
                before[j] = max(before[j], before[i] + 1)
            for i, j, _ in reversed(pairs):
                behind[i] = max(behind[i], behind[j] + 1)
            rows += [(offset + i, offset + j, k, number, before[i], behind[j]) for i, j, k in pairs]
            offset += len(t)
        columns = np.array(rows, int).reshape(-1, 6).T
        return columns[:2], columns[2], columns[3], columns[4:]


def _labelled(shared):
    def run(batches):
        field = shared.value
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            base, texts = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            added = [[] for _ in base]
            if field is not None and any(texts):
                p, at = field.marginals(texts), 0
                for i, nodes in enumerate(texts):
                    for node, chance in zip(nodes, p[at : at + len(nodes)], strict=True):
                        best = int(chance.argmax())
                        if not node["label"] and best and chance[best] >= SURE:
                            added[i].append(f"{KINDS[best - 1]}:{node['start']}:{node['end']}")
                    at += len(nodes)
            place = lambda s: (order[(x := s.split(":"))[0]], int(x[1]), int(x[2]))
            spans = [",".join(sorted(b + a, key=place)) for b, a in zip(base, added, strict=True)]
            sha = [hashlib.sha256(",".join(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sha), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def personal_data(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` and ``spans`` of every row."""
    spark = docs.sparkSession
    narrow_batches(spark)
    found = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_found, FOUND), "mentions")
    sample = (
        found.where(F.size("mentions") > 0)
        .select(F.slice("mentions", 1, FIT_MENTIONS).alias("mentions"), F.xxhash64("doc_id", "base").alias("place"))
        .orderBy("place", F.to_json("mentions"))
        .limit(fit_rows)
        .collect()
    )
    field = Field([[m.asDict() for m in row["mentions"]] for row in sample]) if sample else None
    names = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.mapInArrow(_labelled(spark.sparkContext.broadcast(field)), names)


def op1_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))
