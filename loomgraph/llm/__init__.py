"""Operators of a training-data pipeline: deduplication, filtering, extraction, search, mixing and packing."""
