"""Operators bound to the given tables, each with an equivalent SQL query."""

from priorline.catalog import (
    event_queries,
    game_queries,
    model_queries,
    report_queries,
    serving_queries,
    source_queries,
    stream_queries,
)
from priorline.catalog.registry import REGISTRY

__all__ = [
    "REGISTRY", "event_queries", "game_queries", "model_queries", "report_queries", "serving_queries",
    "source_queries", "stream_queries",
]
