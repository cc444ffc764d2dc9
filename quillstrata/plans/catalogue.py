"""The engine's queries and their SQL."""

from quillstrata.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
