"""Operators of a training-data pipeline (dedup, filters, scoring, archives, mixing).

Nothing else in the library imports this subpackage; the entry module adds its
queries when it is present.
"""
