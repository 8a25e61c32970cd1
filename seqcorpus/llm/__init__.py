"""Operators for training data: token files, packing, search, quality, extraction, sharding, personal data, near copies."""
