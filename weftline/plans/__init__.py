"""Registered queries; importing the package fills the registry."""

from weftline.plans import tables  # noqa: F401, I001
from weftline.plans import pile  # noqa: F401
from weftline.plans import extras  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
