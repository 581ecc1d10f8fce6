"""Registered queries with the SQL that they are held against."""

from . import calendar_queries, cleaning_queries, feature_queries, forecast_queries, io_queries, model_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calendar_queries", "cleaning_queries", "feature_queries", "forecast_queries", "io_queries", "model_queries"]
