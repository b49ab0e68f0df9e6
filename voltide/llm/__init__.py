"""Operators for preparing training data: dedup, search, filters, tokens, packing."""
