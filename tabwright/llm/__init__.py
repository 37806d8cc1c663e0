"""Operators for preparing training data: near and exact duplicates, filters, scores, token files and packing."""
