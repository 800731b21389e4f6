"""Training-data operators: quality, near-duplicates, privacy, mixing and packing.

Nothing outside this subpackage imports it.
"""
