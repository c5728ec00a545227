"""All registered queries."""

from traceaudit.plans import (  # noqa: F401
    feature_queries,
    judging_queries,
    label_queries,
    source_queries,
    span_queries,
    stream_queries,
)
from traceaudit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
