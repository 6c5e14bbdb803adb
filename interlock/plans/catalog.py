"""All queries of the core, by name."""

from __future__ import annotations

from interlock.plans import data_queries, raster_queries, report_queries, search_queries, shape_queries
from interlock.plans.registry import Query

_PARTS = [data_queries.REGISTRY, shape_queries.REGISTRY, report_queries.REGISTRY, search_queries.REGISTRY, raster_queries.REGISTRY]


def queries() -> dict[str, Query]:
    return {k: f for r in _PARTS for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _PARTS for k, s in r.sql.items()}
