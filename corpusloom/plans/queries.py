"""All queries of the corpus engine."""

from __future__ import annotations

from . import corpus_queries, metric_queries, scan_queries, stream_queries, text_queries, token_queries, written_queries  # noqa: F401  their queries register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
