"""Registered queries and their SQL."""

from . import catalog_queries, edge_queries, io_queries, lineage_queries, media_queries, pixel_queries, shape_queries, table_queries

_MODULES = (lineage_queries, table_queries, media_queries, edge_queries, catalog_queries, pixel_queries, io_queries, shape_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in _MODULES for k, f in m.ORACLES.items()}
