"""All registered queries of the market domain."""

from . import checks, data, discovery, entities, market, mining, reports, research, rules, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
