"""Operators for preparing training text: deduplication, filtering, privacy, mixing, packing and archives."""
