"""Importing this registers every query of the engine."""

from flockscope.plans import analytics_queries, content_queries, ingest_queries, investigation_queries, signal_queries, streaming_queries, tool_queries  # noqa: F401
from flockscope.plans.catalog import ORACLE, QUERIES  # noqa: F401
