"""Queries on the given tables, registered by importing their modules."""

from rasterlab.plans import (metric_queries, ml_queries, raster_queries, scan_queries,  # noqa: F401
                             store_queries, stream_queries)
from rasterlab.plans.registry import ORACLES, QUERIES  # noqa: F401
