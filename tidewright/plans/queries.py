"""All queries of the raster engine, by name, and their SQL twins."""

from __future__ import annotations

from tidewright.plans import pixel_queries, space_queries, time_queries

_PARTS = (time_queries, pixel_queries, space_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
FLAGSHIP = "area_accounting"
