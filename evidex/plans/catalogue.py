"""All queries by name, and their SQL."""

from . import metric_queries, ops_queries, report_queries, retrieval_queries, rule_queries, state_queries, text_queries  # noqa: F401  each registers its own
from .registry import ORACLES, QUERIES  # noqa: F401
