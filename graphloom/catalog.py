"""All queries of the graph engine by name, with their SQL."""

from . import queries  # noqa: F401  (registers them)
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
