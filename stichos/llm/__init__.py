"""Operators for preparing training text: tokenising, filtering, deduplicating, scoring and packing documents."""
