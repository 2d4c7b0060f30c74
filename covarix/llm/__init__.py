"""Training-data operators: packing, dedup, search, scoring, extraction and formatting.

Nothing outside this subpackage imports it.
"""
