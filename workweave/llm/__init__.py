"""Operators of a training-data pipeline: deduplication, filtering, extraction, packing.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
