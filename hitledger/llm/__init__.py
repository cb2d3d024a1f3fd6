"""Operators that prepare training text: parsing, joins, filters, deduplication and packing."""
