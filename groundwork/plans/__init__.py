"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from groundwork.plans import access, finance, logs, retrieval, supply, writes
from groundwork.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "access", "finance", "logs", "retrieval", "supply", "writes"]
