"""Training-data operators: deduplication, extraction, counting, mixing and sharding.

Nothing outside this subpackage imports it.
"""
