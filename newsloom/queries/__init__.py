"""Queries over the driver tables: one per operator or group of operators."""

from . import documents, fixed, store, streams, warehouse, web  # noqa: F401  they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
