"""The library's operators, bound to the TPC-H-like tables, each with the SQL of its result."""

from . import conformance, entities, governance, job_cost, marts, matching, quality, reconciliation, relational, stages, staging, traceability  # noqa: F401
from .registry import ORACLES, QUERIES, query, read, views

__all__ = ["ORACLES", "QUERIES", "query", "read", "views"]
