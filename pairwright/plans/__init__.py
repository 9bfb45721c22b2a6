"""Queries over the driver's tables, by theme; each module has ``QUERIES`` and ``ORACLE``."""

from . import check_queries, evidence_queries, genre_queries, pair_queries, search_queries, selector_queries, source_queries, stream_queries, table_queries, template_queries, varied_queries

PLANS = (check_queries, table_queries, stream_queries, genre_queries, pair_queries, search_queries, selector_queries, template_queries, evidence_queries, varied_queries, source_queries)
