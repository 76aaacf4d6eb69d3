"""Recommendation analytics expressed as Spark DataFrame jobs."""

from tastemill.session import build_session

__all__ = ["build_session"]
