"""The registered queries, the frames they run on, and the same queries in SQL."""

from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
