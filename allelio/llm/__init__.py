"""Operators of a training-data pipeline: scanning, deduplication, scoring, mixing, encoding and output of documents."""
