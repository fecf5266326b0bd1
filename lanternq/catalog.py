"""All queries of the core operators on the test tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from lanternq.plans import analytics_queries, pipeline_queries, record_queries, registry, retrieval_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
