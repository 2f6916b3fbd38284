"""Registered queries over the given tables, each with the SQL that must return the same rows."""

from tallywell.queries import (  # noqa: F401
    checking,
    deriving,
    documenting,
    gathering,
    locating,
    matching,
    publishing,
    rostering,
    spending,
    surveying,
    trees,
    viewing,
)
from tallywell.queries.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
