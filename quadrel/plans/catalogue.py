"""Imports every module that registers queries."""

from quadrel.plans import grid_queries, raster_queries, service_queries, vector_queries  # noqa: F401
from quadrel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
