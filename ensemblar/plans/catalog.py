"""All registered queries and their SQL."""

from __future__ import annotations

from . import align_queries, file_queries, index_queries, region_queries, score_queries
from .registry import QUERIES, SQL

MODULES = (align_queries, file_queries, index_queries, region_queries, score_queries)

__all__ = ["MODULES", "QUERIES", "SQL"]
