"""Operators for large training-data pipelines, apart from the rest of the library."""

from plotline.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
