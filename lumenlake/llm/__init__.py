"""Operators of a training-data pipeline: packing, deduplication, scoring, archives and media columns.

Nothing outside this subpackage imports it.
"""
