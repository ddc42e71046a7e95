"""Registered queries."""

from claritas.plans import (  # noqa: F401
    queries_columns,
    queries_metrics,
    queries_shots,
    queries_sources,
    queries_streams,
    queries_tables,
)
from claritas.plans.registry import QUERIES, SQL  # noqa: F401
