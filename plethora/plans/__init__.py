"""All registered queries."""

from plethora.plans import io_queries, kernel_queries, metric_queries, signal_queries  # noqa: F401
from plethora.plans.registry import QUERIES

__all__ = ["QUERIES"]
