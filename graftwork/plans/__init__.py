"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from graftwork.plans import analytics, generated, snapshots, sources
from graftwork.plans.sources import flagship

_MODULES = (sources, generated, snapshots, analytics)
__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
