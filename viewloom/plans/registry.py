"""All queries of the core, in one dictionary."""

from __future__ import annotations

from viewloom.plans import q_clean, q_eval, q_graph, q_profile, q_walks, q_weights, quality

_PARTS = [quality, q_clean, q_weights, q_graph, q_eval, q_walks, q_profile]

QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
