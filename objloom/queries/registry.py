"""All queries of the library."""

from __future__ import annotations

from objloom.queries import codec_queries, graph_queries, more_ref_queries, object_queries, pack_queries, ref_queries, store_queries
from objloom.queries.base import QUERIES, SQL

MODULES = (codec_queries, object_queries, graph_queries, pack_queries, ref_queries, store_queries, more_ref_queries)

__all__ = ["MODULES", "QUERIES", "SQL"]
