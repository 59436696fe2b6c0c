"""All registered queries."""

from tidepool.plans import queries_intel, queries_lists, queries_market, queries_research  # noqa: F401
from tidepool.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
