"""Operators for training-data pipelines: cleaning, deduplication, packing and storage of text."""
