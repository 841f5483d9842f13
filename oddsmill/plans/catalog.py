"""All queries over the market tables, and their SQL."""

from __future__ import annotations

from . import alert_queries, extension_queries, market_queries, score_queries, series_queries, text_queries, trader_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
