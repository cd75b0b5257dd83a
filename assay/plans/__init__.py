"""The registered queries: an operator applied to the bound tables, and the same in SQL."""

from __future__ import annotations

from . import review, sources, text, verdicts  # noqa: F401
from .common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
