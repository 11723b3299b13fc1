"""Registered queries with an independent SQL statement of each result."""

from plotline.catalog.entries import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
