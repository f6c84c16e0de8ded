"""Operators for preparing training text: cleaning, deduplication, filtering, formatting and packing."""
