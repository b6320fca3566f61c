"""Operators for large text corpora: extraction, cleaning, scanning, deduplication, encoding, packing."""
