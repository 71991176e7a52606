"""Registered queries, grouped by subject."""

from catalog import fits, inputs, space  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
