"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from evalloom.plans.catalog import ORACLES, QUERIES
from evalloom.plans import answer_queries, attempt_queries, audit_queries, build_queries, episode_queries, results_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
