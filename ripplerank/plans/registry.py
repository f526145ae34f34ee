"""All queries and their SQL."""

from . import q_controls, q_graph, q_labels, q_metrics, q_models, q_stability, q_stats, q_templates  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
