"""Every query of the library by name, with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function of a :class:`Source`; ``sql`` may use the derived ``views``."""

    def add(f: Callable[[Source], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLES[key] = with_views(sql, *views) if views else sql.strip()
        return f

    return add


from . import function_queries, job_queries, layout_queries, page_queries, quality_queries, table_queries, term_queries, text_queries  # noqa: E402,F401
