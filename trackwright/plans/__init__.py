"""Compositions of operators, and the registered queries."""

from . import box_queries, court_queries, match_queries, misc_queries, pixel_queries, record_queries, series_queries, tracking_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
