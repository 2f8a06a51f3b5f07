"""Queries by name with their SQL."""

from .plans import assessments, behaviours, goals, reviews, rubrics, shopping, trajectories  # noqa: F401  (register their queries)
from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
