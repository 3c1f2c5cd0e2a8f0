"""Registered queries; importing this package registers all of them."""

from spanwell.plans import data_queries, log_queries, source_queries, span_queries, stream_queries  # noqa: F401
from spanwell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
