"""Operators for training data: filters, duplicates, search, tokens and mixtures."""
