"""Training-data operators: sharding, mixing, dedup, extraction, classification.

Nothing outside this subpackage imports it.
"""
