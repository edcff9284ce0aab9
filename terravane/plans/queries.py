"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from terravane.plans import catalogue, rasters, relations, scalars, terrain, visible  # noqa: F401  they register their queries
from terravane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
