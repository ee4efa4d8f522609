"""Operators for preparing language-model training data (packing, dedup, filters, mixing)."""
