"""Operators for training text: linkage, near copies, neighbours, personal data, tokens, packing, cut texts."""
