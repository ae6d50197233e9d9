"""All queries over the core operators, by name, and SQL that gives the same rows."""

from oriel.plans import intake_queries, join_queries, metric_queries, stream_queries, validation_queries  # noqa: F401
from oriel.plans.registry import ORACLE, QUERIES  # noqa: F401
