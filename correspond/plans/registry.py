"""All registered queries and their SQL."""

from correspond.plans import graph, mail, retrieval, rooms, streams  # noqa: F401
from correspond.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
