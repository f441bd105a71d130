"""Queries over the given tables, each with the SQL it is checked against where SQL can state it."""

from . import text_scope, diffs, chunks, retrieval, products, streams  # noqa: F401 - registers
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
