"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from spindle.plans import q_graph, q_inventory, q_quality, q_retrieval, q_sources, q_timeseries  # noqa: F401
from spindle.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
