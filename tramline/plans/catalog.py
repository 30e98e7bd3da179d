"""All registered queries."""

from __future__ import annotations

from . import aggregate_queries, behaviour_queries, caption_queries, chain_queries, fact_queries, frame_queries, geometry_queries, join_queries, lane_queries, record_queries, stream_queries, text_queries, track_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
