"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import catalog, surface_queries, trace_queries
from .registry import ORACLES, QUERIES

MODULES = (catalog, trace_queries, surface_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
