"""All named queries of the engine and their SQL."""

from tracelens.plans import q_basic, q_composite, q_library, q_more  # noqa: F401
from tracelens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
