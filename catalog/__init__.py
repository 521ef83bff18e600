"""Queries over the benchmark tables, each with its SQL twin."""

from catalog import cohorts, derived, tracking  # noqa: F401
from catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
