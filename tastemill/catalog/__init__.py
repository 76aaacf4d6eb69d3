"""Registered queries over the given tables, each with the SQL that defines its result where SQL can."""

from tastemill.catalog import ingestion, sequences, vectors, serving, requests, judging, models, streams  # noqa: F401
from tastemill.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
