"""Bindings of the operators to the driver tables, and the registered queries."""

from . import compose_queries, feature_queries, lake_queries, market_queries, relational_queries, round_trip_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "compose_queries", "feature_queries", "lake_queries", "market_queries", "relational_queries", "round_trip_queries"]
