"""Imports every query module so that its queries are registered."""

from .registry import ORACLES, QUERIES
from . import (  # noqa: F401
    q_census,
    q_classify,
    q_joins,
    q_network,
    q_order,
    q_scalar,
    q_sources,
    q_tiles,
)

__all__ = ["ORACLES", "QUERIES"]
