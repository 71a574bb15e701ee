"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import accounts, documents, layouts, operations, retrieval, reviews, texts  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
