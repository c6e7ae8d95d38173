"""Operators of a training-data pipeline: dedup, packing, scans, scoring, search."""
