"""Placeholder test and redaction for credential-like values."""

from __future__ import annotations

from pyspark.sql import Column

from repoaudit.functions.regex import has_any
from repoaudit.functions.text import redact
from repoaudit.rules.categories import PLACEHOLDER

__all__ = ["is_placeholder", "redact"]


def is_placeholder(line: Column) -> Column:
    """The assigned value is an obvious stand-in or a template reference."""
    return has_any(line, PLACEHOLDER)
