"""Training-data operators: sharding, scoring, deduplication, tokenising and binary output.

Nothing outside this subpackage imports it.
"""
