"""Operators for training-data pipelines: mixing, near-dedup, filters, extraction, classifiers, secrets, PII."""
