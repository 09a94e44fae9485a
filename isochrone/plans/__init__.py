"""Registered queries over the driver tables, next to their SQL equivalents."""

from . import overfit_queries, panel_queries, portfolio_queries, signal_queries, source_queries, streaming_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
