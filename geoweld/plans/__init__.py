"""Registered queries over the driver's tables, each with its SQL."""

from geoweld.plans import files, layers, more, overlays, places, records, roads, shapes, spatial, tables  # noqa: F401
from geoweld.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
