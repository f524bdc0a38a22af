"""Pattern banks: ordered lists of regular expressions, evaluated behind literal checks.

Patterns are written in the common subset of Python, Java and RE2 syntax. On the
JVM they run with Unicode classes (``U``) and ``\\n``-only line ends (``d``),
which is how the rules are meant to be read.

A regular expression costs an order of magnitude more per character than a
substring search. Every pattern is therefore guarded by the literal text it
cannot match without ("needles", read off the parsed pattern): the expression is
only run on texts that hold one of them. The guard never changes a result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the standard library's own pattern parser
    from re import _constants as _codes
    from re import _parser as _syntax
except ImportError:  # pragma: no cover - guards are optional
    _codes = _syntax = None

JVM_FLAGS = "(?Ud)"
MIN_NEEDLE = 2


@dataclass(frozen=True)
class Bank:
    """An ordered list of patterns; order only matters for ``extract_first``."""

    patterns: tuple[str, ...]
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        body = "|".join(self.patterns)
        return f"(?i:{body})" if self.ignore_case else f"(?:{body})"

    @property
    def jvm(self) -> str:
        return JVM_FLAGS + self.regex

    def each(self) -> list[str]:
        """Every pattern on its own, with the case flag applied."""
        return [f"(?i:{p})" if self.ignore_case else p for p in self.patterns]


def bank(*patterns: str, ignore_case: bool = False) -> Bank:
    return Bank(tuple(patterns), ignore_case)


def jvm(pattern: str) -> str:
    return JVM_FLAGS + pattern


def group_count(pattern: str) -> int:
    """Number of capturing groups of a pattern."""
    return re.compile(pattern).groups


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match holds at least one; empty when there is none."""
    if _syntax is None:
        return ()
    return tuple(_needles_of(_syntax.parse(pattern)) or ())


def _needles_of(items) -> list[str] | None:
    """Best mandatory literal set of a sequence: longest shortest member wins."""
    options: list[list[str]] = []
    run = ""
    for op, arg in items:
        if op is _codes.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            options.append([run])
            run = ""
        if op is _codes.SUBPATTERN:
            inner = _needles_of(arg[3])
        elif op is _codes.BRANCH:
            sets = [_needles_of(b) for b in arg[1]]
            inner = None if any(s is None for s in sets) else [n for s in sets for n in s]
        elif op is _codes.MAX_REPEAT and arg[0] >= 1:
            inner = _needles_of(arg[2])
        else:
            inner = None
        if inner:
            options.append(inner)
    if run:
        options.append([run])
    usable = [o for o in options if min(len(n) for n in o) >= MIN_NEEDLE and len(o) <= 12]
    return max(usable, key=lambda o: (min(len(n) for n in o), -len(o))) if usable else None


def fold(text: Column) -> Column:
    """Lower-case form on which needles are searched, covering the odd case folds of i and s."""
    low = F.lower(text)
    for odd, plain in (("i̇", "i"), ("ı", "i"), ("ſ", "s")):
        low = F.replace(low, F.lit(odd), F.lit(plain))
    return low


def guard(low: Column | None, pattern: str) -> Column | None:
    found = needles(pattern) if low is not None else ()
    return reduce(or_, [low.contains(n) for n in found]) if found else None


def matches(col: Column, pattern: str, low: Column | None = None) -> Column:
    """Pattern occurs in the text; ``low`` is the folded text, if there is one to guard with."""
    gate = guard(low, pattern)
    hit = col.rlike(jvm(pattern))
    return hit if gate is None else gate & hit


def has_any(col: Column, rules: Bank, low: Column | None = None) -> Column:
    """True when any pattern of the bank occurs anywhere in the text."""
    if low is None:
        return col.rlike(rules.jvm)
    open_patterns = [p for p in rules.each() if not needles(p)]
    tests = [matches(col, p, low) for p in rules.each() if needles(p)]
    if open_patterns:
        tests.append(col.rlike(jvm("|".join(f"(?:{p})" for p in open_patterns))))
    return reduce(or_, tests)



def extract_first(col: Column, rules: Bank, low: Column | None = None) -> Column:
    """First pattern in bank order that occurs: group 1 if it has one, else the match, trimmed."""
    picks = []
    for pattern in rules.each():
        group = 1 if group_count(pattern) else 0
        hit = F.regexp_extract(col, jvm(pattern), group)
        picks.append(F.when(matches(col, pattern, low), strip(hit)))
    return F.coalesce(*picks)


def strip(col: Column) -> Column:
    """Remove surrounding white space of any kind, not just blanks."""
    return F.regexp_replace(col, jvm(r"^\s+|\s+\z"), "")
