"""Operators of a training-data pipeline over the document, page and vector tables."""
