"""Operators for preparing language-model training data: cleaning, deduplication, tokens, packing, shards."""
