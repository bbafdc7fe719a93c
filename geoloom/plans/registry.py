"""All queries of the engine proper by name, and their SQL."""

from __future__ import annotations

from . import analytics_queries, catalog_queries, geo_queries, pixel_queries, shape_queries, store_queries, summary_queries, text_queries

MODULES = [store_queries, geo_queries, catalog_queries, pixel_queries, summary_queries, text_queries, analytics_queries, shape_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
