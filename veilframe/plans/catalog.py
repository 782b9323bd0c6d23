"""The queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from . import agent_queries, detector_queries, flow_queries, page_queries, sanitize_queries, spatial_queries, validator_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (validator_queries, detector_queries, spatial_queries, page_queries, flow_queries, agent_queries, sanitize_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
