"""All registered queries."""

from __future__ import annotations

from quillmere.plans import (  # noqa: F401  (importing registers)
    log_queries, search_queries, stream_queries, table_queries, text_queries,
)
from quillmere.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
