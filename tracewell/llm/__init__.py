"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
queries for the driver contract.
"""
