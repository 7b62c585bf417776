"""All registered queries and their SQL."""

from tidewatch.plans import catalog_queries, log_queries, series_queries, stream_queries  # noqa: F401
from tidewatch.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
