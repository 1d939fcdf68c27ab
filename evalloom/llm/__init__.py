"""Operators for preparing training data, and their registered queries."""

from evalloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
