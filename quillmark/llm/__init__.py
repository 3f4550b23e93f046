"""Operators for training data: tokens, packing, filters, duplicates, archives."""
