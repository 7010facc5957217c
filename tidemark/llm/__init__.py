"""Training-data operators: quality, dedup, scoring, packing, mixing, sharding, extraction.

Nothing outside this subpackage imports it.
"""
