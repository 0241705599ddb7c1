"""Registered queries and their SQL."""

from __future__ import annotations

from waystone.plans import q_aggregates, q_audit, q_graph, q_joins, q_routes, q_rules, q_select, q_sources, q_streams, q_tracks  # noqa: F401
from waystone.plans.registry import QUERIES, SQL  # noqa: F401
