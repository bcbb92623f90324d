"""Every registered query with its SQL: importing this module registers all of them."""

from __future__ import annotations

from . import annotation_queries, knowledge_queries, pipeline_queries, retrieval_queries, scoring_queries  # noqa: F401
from .registry import Query, oracle_sql, queries

__all__ = ["Query", "oracle_sql", "queries"]
