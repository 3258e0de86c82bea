"""Named queries over the star-schema tables, each with an equivalent SQL text.

A query maps an operator onto the tables (events as samples, part names as
towns, and so on) and runs over whole tables.
"""

from __future__ import annotations

from epilode.catalog import registry
from epilode.catalog import (  # noqa: F401  (imported for registration)
    aggregate_queries,
    census_queries,
    feed_queries,
    matching_queries,
    projection_queries,
    relational_queries,
    scalar_queries,
    spatial_queries,
    trend_queries,
)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
