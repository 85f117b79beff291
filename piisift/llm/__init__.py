"""Operators of a training-data pipeline: cleaning, deduplication, tokenising, scoring and packing.

Nothing else in the library imports this package.  ``catalog`` lists its registered queries.
"""
