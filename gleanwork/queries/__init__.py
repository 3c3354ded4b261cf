"""The registered queries: every operator over the whole given tables."""

from gleanwork.queries import (  # noqa: F401
    boards,
    bronze,
    claims,
    functions,
    html,
    mapping,
    quality,
    search,
    silver,
    snapshot,
    streams,
)
from gleanwork.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
