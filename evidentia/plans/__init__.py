"""Registered queries: each names an operator, applies it to whole tables and states its oracle in SQL."""

from . import claims, consumers, contracts, indexes, learning, lifecycle, ranking, records, relations, scans, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
