"""Operators of a training-data pipeline: scans, tokenising, deduplication, scoring, mixing and sharding."""
