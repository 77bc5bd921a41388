"""All registered queries."""

from tallmat.plans import algebra, factorizations, io, products, wide  # noqa: F401
from tallmat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
