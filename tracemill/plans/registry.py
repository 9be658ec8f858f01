"""All queries over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from tracemill.plans import log_queries, text_queries, trace_queries  # noqa: F401  they register their queries
from tracemill.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
