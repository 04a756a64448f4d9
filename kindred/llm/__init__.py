"""Operators that prepare training data: deduplication, scans, packing, mixing, sharding, token files and language ID."""
