"""Training-data operators: scoring, filtering, deduplication, packing and search.

Nothing outside this subpackage imports it.
"""
