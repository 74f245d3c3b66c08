"""Operators for training-data pipelines: deduplication, quality, language, mixing, sharding, tokens.

Nothing else in the library imports this subpackage; ``registry`` holds its queries and their SQL.
"""
