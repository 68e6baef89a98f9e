"""Operators for large training-data pipelines (deduplication, quality, packing, mixing, search)."""
