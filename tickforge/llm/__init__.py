"""Operators of a training-data pipeline: search, sharding, packing, filtering, dedup, media, tokens.

Nothing else in the library imports this subpackage.
"""
