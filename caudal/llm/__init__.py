"""Operators for training-data pipelines over the text tables.

Self-contained: nothing else in the library imports this package. The
registered queries and their SQL are in :mod:`caudal.llm.queries`.
"""
