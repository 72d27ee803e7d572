"""Operators for preparing training text: filters, near-duplicates, archives, search and tokens."""
