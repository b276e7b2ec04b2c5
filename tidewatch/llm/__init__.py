"""Operators for large training-data pipelines: formatting, deduplication, filtering, decontamination, encoding."""
