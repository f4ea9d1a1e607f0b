"""Operators for training-data pipelines: filtering, deduplication, labelling, mixing, packing.

Nothing else in the library imports this package; ``registry`` lists its
queries for the driver entry.
"""
