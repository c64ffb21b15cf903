"""Training-data operators: quality, search, dedup, extraction, tokens, packing, scoring.

Nothing outside this subpackage imports it.
"""
