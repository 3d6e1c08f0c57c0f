"""The registered queries, grouped by area."""

from labelgrid.plans import catalog, evaluation, matching, search, texts, upkeep  # noqa: F401
from labelgrid.plans.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
