"""All registered queries: importing this module registers them."""

from chronoplate.plans import area_queries, domain_queries, flat_queries, geometry_queries, measurement_queries, overlay_queries, rotation_queries, sampler_queries, source_queries, text_queries  # noqa: F401
from chronoplate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
