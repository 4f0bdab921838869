"""Corpus operators: identity, order, sharding, tokenising, packing, splits, merges, mixes."""
