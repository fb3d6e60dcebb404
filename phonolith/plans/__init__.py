"""Registered queries: importing the modules fills the registry."""

from phonolith.plans import cells, files, graphs, linkage, models, places, polygons, polylines, quality, reports, roads, scenes, spatial, streams, temporal  # noqa: F401
from phonolith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
