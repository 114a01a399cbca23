"""All queries of the library, and SQL of the same meaning where SQL can express them."""

from driftline.plans import aggregate_queries, kernel_queries, ordered_queries, projections, relational_queries, source_queries  # noqa: F401
from driftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
