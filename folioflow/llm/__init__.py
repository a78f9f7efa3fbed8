"""Training-data operators: sharding, language ID, tokenising, deduplication, archives, extraction.

Nothing outside this subpackage imports it.
"""
