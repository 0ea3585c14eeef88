"""Operators for building training data: sharding, deduplication, search, tokens, packing, classifiers."""
