"""Registered queries. Importing this package fills the registry."""

from repoaudit.queries import base, basics, category, chain, code, contracts, docs, health, surfaces  # noqa: F401
from repoaudit.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
