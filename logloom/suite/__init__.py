"""Registered queries: every operator on the shared test tables, next to the SQL that checks it."""

from logloom.suite import (  # noqa: F401
    aggregate_queries, chart_queries, function_queries, ingest_queries, wire_queries, join_queries,
    maintenance_queries, rule_queries, search_queries, stream_queries,
)
from logloom.suite.base import ORACLES, QUERIES  # noqa: F401
