"""Training-data operators: quality, packing, near and exact deduplication, mixing, extraction, token files.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
