"""All registered queries."""

from nightgrid.plans import (  # noqa: F401
    inventory_queries, label_queries, raw_queries, release_queries, signal_queries, window_queries,
)
from nightgrid.plans.registry import QUERIES, SQL  # noqa: F401
