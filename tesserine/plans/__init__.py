"""Registered queries over the driver's tables, each with the SQL it is held against."""

from tesserine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]


def load() -> None:
    """Imports all query modules, which register themselves."""
    from tesserine.plans import collections, files, graphs, inference, learning, relational, tpch  # noqa: F401
