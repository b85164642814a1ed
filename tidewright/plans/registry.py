"""All queries over the library's operators, and their SQL."""

from __future__ import annotations

from tidewright.plans import edge_queries, field_queries, grid_queries, path_queries, route_queries, scalars, series_queries, shore_queries, source_queries, stream_queries, table_queries

MODULES = (scalars, series_queries, grid_queries, route_queries, field_queries, table_queries, stream_queries, edge_queries, path_queries, shore_queries, source_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
